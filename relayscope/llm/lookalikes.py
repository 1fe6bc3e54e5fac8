"""Text that looks the same, in one form.

Values are exploded to positioned code points. Fixed tables, built from Unicode's own data, are joined
to them: decompositions, combining classes, look-alike letters, and the compositions that put marks
back on their letters. Marks are ordered by class, letters recomposed, strings rebuilt.

Which letter of a look-alike pair is meant depends on the word: the script of its letters that have no
double decides, else that of the whole value, else Latin. The tables cover what is spelled otherwise but
reads the same: full-width and styled letters, ligatures, odd spaces and hyphens, invisible characters,
letters of other scripts. Accents, dashes, signs and whole names in Cyrillic or Greek stay as they are.

Defined results: null values have no row; plain values, the empty one included, are their own plain
form. Values of any length are read whole. Marks come out as in NFC, however many there are and whatever
stands between them; so does Hangul.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters that look like a Latin one. Below, each Latin letter with its doubles.
_DOUBLES = """
a а α ɑ
b Ь ƅ
c с ϲ ⅽ
d ԁ ⅾ
e е ҽ
f ƒ
g ɡ ց
h һ հ
i і ι ⅰ
j ј ϳ
k κ
l ӏ ⅼ
m ⅿ
n ո
o о ο օ
p р ρ
q ԛ զ
r г
s ѕ
u ս υ
v ν ѵ ⅴ
w ԝ ա
x х χ ⅹ
y у γ
A А Α
B В Β
C С Ϲ
E Е Ε
F Ϝ
G Ԍ
H Н Η
I І Ι Ӏ
J Ј
K К Κ
M М Μ
N Ν
O О Ο Օ
P Р Ρ
Q Ԛ
S Ѕ Տ
T Т Τ
U Ս
V Ѵ
W Ԝ
X Х Χ
Y Ү Υ
Z Ζ
A ꓮ
B ꓐ
C ꓚ
D ꓓ
E ꓰ
F ꓝ
G ꓖ
H ꓧ
I ꓲ
J ꓙ
K ꓗ
L ꓡ
M ꓟ
N ꓠ
O ꓳ
P ꓑ
R ꓣ
S ꓢ
T ꓔ
U ꓴ
V ꓦ
W ꓪ
X ꓫ
Y ꓬ
Z ꓜ
"""
# The doubles that are letters of everyday Cyrillic or Greek, so may be meant as such.
_EVERYDAY = set("асеіјорѕухАВСЕНІЈКМОРЅТХгЬαικνορυχγςΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
_WEAK = set("гЬγυ")  # of these, the ones that pass for Latin but aren't passed for by it
#: Decompositions by these tags change only the look.
_LOOK_TAGS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<circle>"}
# Latin ligatures, and hyphens and spaces that are not the ordinary ones.
_LIGATURES = range(0xFB00, 0xFB07)
_HYPHENS = "‐‑‒−﹣"
_SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 9, 10, 11, 12, 13, 0x85]))
_FREE_MARKS = range(0xFE00, 0xFE10)  # variation selectors
_EAST = "east"  # scripts of Chinese, Japanese and Korean, which are written together
# Scripts without case, by the names that regular expressions know them by.
_CASELESS = "Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai Lao Tibetan Myanmar Ethiopic Khmer Mongolian Lisu Yi".split()


def _caseless_script(p: F.Column) -> F.Column:
    """The script of a letter that ``point_table`` leaves out."""
    found = F.when(p.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsBopomofo}]"), _EAST)
    for name in _CASELESS:
        found = found.when(p.rlike(rf"^\p{{Is{name}}}"), name.lower())
    return F.when((p > "\u02af") & p.rlike(r"^\p{L}"), found.otherwise("other"))


def _script(ch: str) -> str | None:
    if not ch.isalpha():
        return None
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    name = unicodedata.name(ch, "")
    if name.startswith(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO")):
        return _EAST
    return "L" if name.startswith("LATIN") else name.split(" ")[0].lower()


def _look(ch: str) -> str | None:
    """What the code point looks like in ordinary spelling, '' for nothing, None if it is ordinary."""
    o = ord(ch)
    if ch in _SPACES:
        return " "
    if ch in _HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Cc") or o in _FREE_MARKS or o == 0x115F or o == 0x3164:
        return ""
    raw = unicodedata.decomposition(ch)
    if o in _LIGATURES or (raw.startswith("<") and raw.split(" ")[0] in _LOOK_TAGS):
        out = "".join(map(chr, (int(x, 16) for x in raw.split(" ") if not x.startswith("<"))))
        return "".join(y for x in out for y in (_look(x) if _look(x) is not None else x))
    return None


@lru_cache(maxsize=1)
def _tables() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(code points, compositions by base letter, doubles), each of a size that Unicode fixes."""
    doubles: dict[str, tuple[str, bool]] = {}
    back: dict[tuple[str, str], str] = {}
    for line in _DOUBLES.split("\n"):
        latin, *others = line.split() or [""]
        for other in others:
            doubles[other] = (latin, other in _EVERYDAY)
            script = _script(other)
            if other in _EVERYDAY and other not in _WEAK and script and (script, latin) not in back:
                back[(script, latin)] = other
    points = []
    composed: dict[str, list[tuple[str, str]]] = defaultdict(list)  # first -> (second, both in one)
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or 0xAC00 <= o < 0xD7A4:
            continue
        ch = chr(o)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        look = _look(ch)
        parts = unicodedata.normalize("NFD", ch if look is None else look)
        raw = unicodedata.decomposition(ch).split(" ")
        if look is None and len(raw) == 2 and not raw[0].startswith("<") and unicodedata.normalize("NFC", parts) == ch:
            composed[chr(int(raw[0], 16))].append((chr(int(raw[1], 16)), ch))
        if kind[0] != "L" and look is None and parts == ch and not unicodedata.combining(ch):
            continue  # nothing to know
        if kind == "Lo" and look is None and parts == ch and ch not in doubles:
            continue  # letters of scripts without case: the script is all there is to know, see ``_caseless_script``
        points.append((ch, [(p, unicodedata.combining(p)) for p in parts], _script(parts[0]) if parts else None))
    compositions = []
    made = {both for held in composed.values() for _, both in held}
    for base in composed:
        if base in made:
            continue
        closure, open_ = {}, [base]
        while open_:
            first = open_.pop()
            for second, both in composed.get(first, ()):
                closure[first + second] = both
                open_.append(both)
        compositions.append((base, closure))
    for lead in range(19):  # Hangul follows a rule instead of a list
        closure = {}
        for vowel in range(21):
            open_syllable = chr(0xAC00 + (lead * 21 + vowel) * 28)
            closure[chr(0x1100 + lead) + chr(0x1161 + vowel)] = open_syllable
            closed = {open_syllable + chr(0x11A7 + tail): chr(ord(open_syllable) + tail) for tail in range(1, 28)}
            closure |= closed
            compositions.append((open_syllable, closed))
        compositions.append((chr(0x1100 + lead), closure))
    pairs = [(o, latin, everyday) for o, (latin, everyday) in doubles.items()]
    return points, compositions, [*((o, "L", latin, everyday) for o, latin, everyday in pairs), *((latin, script, o, True) for (script, latin), o in back.items())]


def point_table(spark: SparkSession) -> DataFrame:
    """ch -> parts (code point and combining class, canonically decomposed), script."""
    return spark.createDataFrame(_tables()[0], "ch string, parts array<struct<p:string,ccc:int>>, script string")


def composition_table(spark: SparkSession) -> DataFrame:
    """base -> all compositions that can come about from it: a character and the one after it -> both in one."""
    return spark.createDataFrame(_tables()[1], "base string, closure map<string,string>")


@lru_cache(maxsize=1)
def _joining() -> list[str]:
    """Characters of combining class 0 that compose with the one before them, Hangul aside."""
    seconds = {pair[-1] for _, closure in _tables()[1] for pair in closure}
    return sorted(c for c in seconds if not unicodedata.combining(c) and not 0x1100 <= ord(c) < 0x1200)


def compose(marks: F.Column, closure: F.Column) -> F.Column:
    """Text of one cluster (structs of ccc and q in canonical order), each character composed that isn't blocked from the letter before it."""
    text = lambda x: F.concat(x["out"], x["cur"], x["rest"])
    state = lambda out, cur, rest, last: F.struct(out.alias("out"), cur.alias("cur"), rest.alias("rest"), last.alias("last"))
    none = F.lit("")

    def step(acc, m):
        both = F.try_element_at(closure, F.concat(acc["cur"], m["q"]))
        blocked = F.when(m["ccc"] == 0, acc["rest"] != "").otherwise((acc["rest"] != "") & (acc["last"] >= m["ccc"]))
        joined = state(acc["out"], both, acc["rest"], acc["last"])
        begun = state(text(acc), m["q"], none, F.lit(0))
        kept = state(acc["out"], acc["cur"], F.concat(acc["rest"], m["q"]), m["ccc"])
        return F.when(m["q"] == "", acc).when(both.isNotNull() & ~blocked, joined).when(m["ccc"] == 0, begun).otherwise(kept)

    return F.when(F.size(marks) == 1, F.get(marks, F.lit(0))["q"]).otherwise(F.aggregate(marks, state(none, none, none, F.lit(0)), step, text))


def double_table(spark: SparkSession) -> DataFrame:
    """p, target script -> the letter of that script that looks like it; whether p is an everyday letter."""
    return spark.createDataFrame(_tables()[2], "p string, target string, double string, everyday boolean")


#: Values of printable ASCII only are in plain form.
_CANDIDATE = r"[^\x20-\x7E]"


def plain_forms(values: DataFrame, key: list[str], value: str, unless: str | None = None) -> DataFrame:
    """``key`` and ``plain`` for each value that isn't printable ASCII; ``mixed`` marks values whose plain
    form still mixes scripts. ``key`` identifies a row; equal keys must have equal values. Rows whose
    boolean column ``unless`` is true are left out."""
    spark = values.sparkSession
    named, key = key, [f"_key{i}" for i in range(len(key))]  # so that no column of the caller's meets one in here
    chosen = values.where(~F.col(unless)) if unless else values
    rows = chosen.select(*[F.col(n).alias(k) for n, k in zip(named, key)], F.col(value).alias("_v")).where(F.col("_v").rlike(_CANDIDATE)).distinct()
    # one exchange on the key serves every window and aggregation below
    exploded = rows.select(*key, F.posexplode(F.split("_v", "")).alias("pos", "ch"))
    points = F.broadcast(point_table(spark))  # about 5 000 rows, fixed by Unicode
    looked = exploded.join(points, "ch", "left").select(*key, "pos", F.coalesce("parts", F.array(F.struct(F.col("ch").alias("p"), F.lit(0).alias("ccc")))).alias("parts"))
    pieces = looked.select(*key, "pos", F.posexplode_outer("parts").alias("sub", "part")).select(
        *key, "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("part.p", F.lit("")).alias("p"), F.coalesce("part.ccc", F.lit(0)).alias("ccc")
    )
    doubles = F.broadcast(double_table(spark).groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("target", "double"))).alias("doubles"), F.min("everyday").alias("everyday")))
    scripts = F.broadcast(point_table(spark).select(F.col("ch").alias("p"), "script").where("script is not null"))
    known = pieces.join(doubles, "p", "left").join(scripts, "p", "left").withColumn("script", F.coalesce("script", _caseless_script(F.col("p"))))
    whole = Window.partitionBy(*key)
    order = whole.orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    # a word ends at whatever is neither letter nor mark nor nothing
    broken = F.when((F.col("p") != "") & F.col("script").isNull() & (F.col("ccc") == 0) & ~F.col("p").rlike(r"[\p{L}\p{M}]"), 1).otherwise(0)
    starts = (F.col("ccc") == 0) & (F.col("p") != "")
    joins = F.col("p").isin(_joining()) | F.col("p").between("\u1161", "\u11c2")
    counted = known.withColumns({"word": F.sum(broken).over(order), "cluster": F.sum(F.when(starts & ~joins, 1).otherwise(0)).over(order), "start": F.sum(F.when(starts, 1).otherwise(0)).over(order)})
    own = F.col("doubles").isNull() & F.col("script").isNotNull()  # letters without a double
    word = Window.partitionBy(*key, "word")

    def most(window) -> F.Column:
        n = {s: F.sum(F.when(own & (F.col("script") == s), 1).otherwise(0)).over(window) for s in "LCG"}
        return F.when((n["L"] == 0) & (n["C"] == 0) & (n["G"] == 0), None).when((n["L"] >= n["C"]) & (n["L"] >= n["G"]), "L").when(n["C"] >= n["G"], "C").otherwise("G")

    # without any letter of its own, a word is what all its letters are, if they are of one script
    one = F.when(F.min("script").over(word) == F.max("script").over(word), F.min("script").over(word))
    aimed = counted.withColumn("target", F.coalesce(most(word), most(whole), one, F.lit("L")))
    swap = F.col("doubles").isNotNull() & (F.col("script").isNull() | (F.col("script") != F.col("target")) | ~F.col("everyday") & (F.col("script") == "L") & (F.col("target") == "L") & ~F.col("p").rlike("[A-Za-z]"))
    spelled = aimed.withColumn("q", F.when(swap, F.coalesce(F.try_element_at("doubles", F.col("target")), F.col("p"))).otherwise(F.col("p")))
    script = F.when(F.col("q") == F.col("p"), F.col("script")).when(F.col("q") != "", F.col("target"))
    joined = (
        spelled.withColumn("s", script)
        .groupBy(*key, "cluster")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "ccc", "pos", "sub", "q"))).alias("marks"),
            F.collect_set("s").alias("s"),
        )
        .withColumn("base", F.when(F.size("marks") > 1, F.get(F.filter("marks", lambda m: (m["ccc"] == 0) & (m["q"] != "")), F.lit(0))["q"]))
    )
    compositions = F.broadcast(composition_table(spark))  # about 800 rows, fixed by Unicode
    composed = joined.join(compositions, "base", "left").select(*key, "cluster", "s", compose(F.col("marks"), F.col("closure")).alias("text"))
    rebuilt = composed.groupBy(*key).agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("cluster", "text"))), lambda x: x["text"])).alias("plain"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("s")))) > 1).alias("mixed"),
    )
    return rebuilt.select(*[F.col(k).alias(n) for n, k in zip(named, key)], "plain", "mixed")
