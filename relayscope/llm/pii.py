"""Personal information in free text, found and replaced by typed placeholders.

Kinds: ``person_name``, ``email``, ``phone``, ``id_number``, ``street_address``. A placeholder shows the
kind and a pseudonym that links equal values across documents: numbers are permuted within their format
(``pseudonyms``), those with valid check characters to valid ones (``checks``); birth dates are permuted
among the days of 150 years; names and addresses get a keyed tag of 64 bits.

A number counts by its shape and its surroundings, as people also write down numbers that don't check;
account and payment card numbers, whose shape says little, count only if they check.

Values are looked at in ordinary spelling: garbled text is restored first (``mojibake``) and look-alike
characters are read as what they look like. What isn't replaced keeps the characters it had, but for
garbled values, whose placeholders are put into the restored text.

Names are found by shape and by what their words are: given names from a fixed list or from the
corpus' own addresses, family names from the addresses. Two words that stand for given and family name
in addresses with several partners each are known as such. That knowledge is two bit sets, each of 16 to
32 bits a known word, so that one unknown word in 400 at most passes for known at any size of the corpus.

Defined results: null values have no mention and stay null, empty ones stay empty. Values are read whole.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.functions.stamps import MONTHS
from relayscope.llm import checks, lookalikes, mojibake, pseudonyms
from relayscope.session import materialize

KINDS = ("person_name", "email", "phone", "id_number", "street_address")
BIRTH_DATE = "date"  # masked too, but no kind of mention by itself

# --- ordinary spelling ------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _doubles() -> dict[str, str]:
    """Latin doubles of letters."""
    return {p: q for p, target, q, _ in lookalikes._tables()[2] if target == "L"}


@lru_cache(maxsize=8192)
def _ordinary(ch: str) -> str:
    look = lookalikes._look(ch)
    return ch if look is None else look


def ordinary(text: str) -> tuple[str, list[int]]:
    """``text`` in ordinary spelling, and for each character the place it comes from (one more for the end)."""
    if text.isascii():
        return text, list(range(len(text) + 1))
    doubles = _doubles()
    out: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        for x in _ordinary(ch) if ch > "\x7e" else ch:
            out.append(x)
            at.append(i)
    # a letter with a Latin double is read as Latin in a word, or failing that a value, with Latin letters of its own
    own = [lookalikes._script(x) == "L" and x not in doubles for x in out]
    somewhere = any(own)
    n, i = len(out), 0
    while i < n:
        j = i
        while j < n and (out[j].isalpha() or unicodedata.combining(out[j])):
            j += 1
        if j > i:
            word = out[i:j]
            if any(x in doubles for x in word) and (any(own[i:j]) or somewhere and all(x in doubles or unicodedata.combining(x) for x in word)):
                out[i:j] = [doubles.get(x, x) for x in word]
        i = max(j, i + 1)
    at.append(len(text))
    return "".join(out), at


# --- what words are -----------------------------------------------------------------------------------

BITS, MOST_BITS = 1 << 20, 1 << 29  # least and most bits of a set of words
_BITS_A_WORD = 16
_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "’": "", "'": "", "-": ""})


@lru_cache(maxsize=65536)
def fold(word: str) -> str:
    """Small letters without accents and hyphens, as in addresses."""
    flat = unicodedata.normalize("NFKD", word.lower().translate(_SPECIAL))
    return "".join(c for c in flat if not unicodedata.combining(c)).translate(_SPECIAL)


def _places(token: str, bits: int = BITS) -> list[int]:
    digest = hashlib.md5(token.encode("utf-8")).digest()
    return [int.from_bytes(digest[i : i + 4], "big") % bits for i in range(0, 16, 4)]


@dataclass
class NameKnowledge:
    """Bit sets of words that are given and family names."""

    given: bytes
    family: bytes

    def __post_init__(self) -> None:
        self._known: dict[tuple[bool, str], bool] = {}

    def _cached(self, given: bool, word: str, test) -> bool:
        key = (given, word)
        found = self._known.get(key)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = self._known[key] = test(word)
        return found

    @staticmethod
    def _has(bits: bytes, token: str) -> bool:
        return all(bits[p >> 3] >> (p & 7) & 1 for p in _places(token, 8 * len(bits)))

    def is_given(self, word: str) -> bool:
        return self._cached(True, word, self._is_given)

    def is_family(self, word: str) -> bool:
        return self._cached(False, word, self._is_family)

    def _is_given(self, word: str) -> bool:
        token = fold(word)
        if mojibake.LOST in token:
            return self._any(token, self._is_given)
        return token in GIVEN or self._has(self.given, token)

    def _is_family(self, word: str) -> bool:
        token = fold(word)
        if mojibake.LOST in token:
            return self._any(token, self._is_family)
        return len(token) > 2 and self._has(self.family, token)

    @staticmethod
    def _any(token: str, test) -> bool:
        """With up to three lost letters, any letters in their places; a single one may stand for two."""
        lost = token.count(mojibake.LOST)
        if lost > 3 or len(token) - lost < 3 and lost > 1 or len(token) < 3:
            return False
        letters = "aeiouyncslzrgtd"
        if any(test(token.replace(mojibake.LOST, c, 1)) for c in letters):
            return True
        return lost == 1 and any(test(token.replace(mojibake.LOST, c + d)) for c in letters for d in letters)


_PAGE = 32768  # bits of one page of Spark's bitmap aggregate


def _bits(places: list[int]) -> bytes:  # of a set of the least size
    out = bytearray(BITS // 8)
    for p in places:
        out[p >> 3] |= 1 << (p & 7)
    return bytes(out)


_PERSONAL = r"(?i)(?<![a-z0-9.+_-])([a-z]{3,20})[._]([a-z]{3,24})\d{0,4}@"


def name_knowledge(texts: DataFrame, columns: list[str]) -> NameKnowledge:
    """Given and family names out of personal addresses (given.family@) in the text ``columns``.

    A word counts if it has at least two partners, which role addresses seldom have. The words are
    counted first; the bit sets are sized by that, put together by Spark page by page, and come back to
    the driver: at most ``MOST_BITS`` bits each (64 MB, for 33 million names).
    """
    found = None
    for c in columns:
        both = F.arrays_zip(F.regexp_extract_all(F.col(c), F.lit(_PERSONAL), F.lit(1)).alias("g"), F.regexp_extract_all(F.col(c), F.lit(_PERSONAL), F.lit(2)).alias("f"))
        one = texts.where(F.col(c).contains("@")).select(F.explode(both).alias("x")).select(F.lower("x.g").alias("g"), F.lower("x.f").alias("f"))
        found = one if found is None else found.unionAll(one)
    roles = sorted(ROLES)
    pairs = found.where(~F.col("g").isin(roles) & ~F.col("f").isin(roles)).distinct()

    both_ways = F.array(F.struct(F.lit(0).alias("side"), F.col("g").alias("w"), F.col("f").alias("p")), F.struct(F.lit(1).alias("side"), F.col("f").alias("w"), F.col("g").alias("p")))
    several = pairs.select(F.explode(both_ways).alias("x")).select("x.*").groupBy("side", "w").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b")
    words = materialize(several.select("side", "w"), "names")
    many = max([r["count"] for r in words.groupBy("side").count().collect()], default=0)
    bits = bits_for(many)
    digest = F.md5("w")
    places = [F.conv(F.substring(digest, i, 8), 16, 10).cast("bigint") % bits for i in range(1, 33, 8)]
    at = words.select("side", F.explode(F.array(*places)).alias("p"))
    paged = at.groupBy("side", F.bitmap_bucket_number(F.col("p") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    sets = [bytearray(bits // 8), bytearray(bits // 8)]
    for r in paged.collect():  # pages of 4 KB, as many as the sets have
        sets[r["side"]][(r["page"] - 1) * _PAGE // 8 : r["page"] * _PAGE // 8] = r["bits"]
    return NameKnowledge(bytes(sets[0]), bytes(sets[1]))


def bits_for(words: int) -> int:
    """Bits of a set of so many words: a power of two."""
    bits = max(BITS, 1 << (_BITS_A_WORD * words - 1).bit_length()) if words else BITS
    if bits > MOST_BITS:
        raise ValueError(f"{words} different names need more than {MOST_BITS} bits: run the corpus in parts, or raise MOST_BITS where executors have the memory")
    return bits


# Given names that are common somewhere in Europe, America, Africa or Asia, without accents.
GIVEN = frozenset(
    """
adam agnes aisha alan albert alejandro alex alexander alfred ali alice amelie amina ana andre andrea andrew angela anita
anjali anna anne anton antonio arthur astrid barbara beatrice ben bianca bjorn bruno camille carl carla carlos carmen caroline
catherine charles charlotte chloe christian christine clara claire claudia daniel dario david diana diego dmitri edgar elena
elias elisa elizabeth ella emeka emil emily emma eric erik ernst eva farah fatima felix fernando florian francesca francisco
francois francoise frank gabriel george giulia greta gustav hannah hanne hans harry hassan helen helene heloise henry hugo ibrahim
ines ingrid irina isabel ivan jack jacob james jan jane javier jean joanna john jonas jorg jorge jose joseph juan julia julian
jurgen karl karin katarina kevin kofi lars laura lea leila lena leo linda lisa louis luc lucas lucia luis luisa magda manuel marco
marc margaret maria marie mario mark martha martin mary matteo matthias max mehmet mia michael miguel mohamed monica nadia natalia
nicolas nina noah noor olga oliver olivia omar oscar oskar pablo paolo patrick paul paula pedro peter petra philip pierre piotr
priya rachel rafael ravi rebecca renee richard robert roberto rosa ruth salma sam samuel sandra sara sarah sebastian selma sergei
simon sofia solveig sonja soren stefan stellan stephen steve susan sven tamsin teresa thomas tomas ursula valentina vera victor
viktor walter wanda william ximena yuki yusuf zoe zora
игорь ольга денис мария анна иван сергей елена александр алексеи андреи наталья татьяна дмитрии владимир юрии светлана павел
νικος ελενη μαρια γιωργος κωστας αννα γιαννης δημητρης κατερινα σοφια
""".split()
)
# Local parts and words of roles, not of persons.
ROLES = frozenset("accounts admin billing contact customer desk helpdesk hello info jobs mail newsletter noreply no-reply notifications office orders payroll postmaster press sales security service shipping support team webmaster".split())
# Titles before names.
_TITLE = r"(?:Dr|Drs|Prof|Mr|Mrs|Ms|Miss|Mx|Mme|Mlle|M|Herr|Frau|Hr|Fr|Sr|Sra|Srta|Don|Doña|Sir|Dame|Monsieur|Madame)"
_NOT_FAMILY = frozenset("accounts and billing bestellungen buchhaltung care cliente compliance customer desk energy facturacion for freight from group helpdesk intake is kundigungsstelle logistics newsletter notifications of office payable payroll rewards says security service shipping sons support team the to via was will with und et y de".split())

_NAME_WORD = r"[^\W\d_](?:[^\W\d_]|[’'�\u0300-\u036f])*(?:-[^\W\d_](?:[^\W\d_]|[’'�\u0300-\u036f])*)*"
_TOKEN = re.compile(rf"(?:(?<!�)�++)?{_NAME_WORD}|[^\s]")
_TITLES = frozenset("dr drs prof mr mrs ms miss mx mme mlle m herr frau hr fr sr sra srta don doña sir dame monsieur madame".split())


def _capital(word: str) -> bool:
    return word[0].isupper() or word[0] == mojibake.LOST


def find_names(text: str, known: NameKnowledge) -> list[tuple[int, int]]:
    """Places of person names."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    n, i, out = len(tokens), 0, []

    def word(k: int) -> str | None:
        return tokens[k][2] if k < n and (tokens[k][2][0].isalpha() or tokens[k][2][0] == mojibake.LOST) else None

    def near(k: int) -> bool:
        """Nothing but blanks between this token and the one before."""
        return text[tokens[k - 1][1] : tokens[k][0]].strip() == "" and "\n" not in text[tokens[k - 1][1] : tokens[k][0]]

    def initial(k: int) -> int:
        """The token after an initial with its full stop, or k."""
        w = word(k)
        if w is not None and len(w) == 1 and _capital(w) and k + 1 < n and tokens[k + 1][2] == "." and tokens[k + 1][0] == tokens[k][1]:
            return k + 2
        return k

    while i < n:
        w = word(i)
        if w is None:
            i += 1
            continue
        start, k, titled = i, i, False
        if w.lower() in _TITLES and _capital(w):
            j = i + 1
            if j < n and tokens[j][2] == "." and tokens[j][0] == tokens[i][1]:
                j += 1
            if j < n and near(j) and word(j) is not None and (j > i + 1 or w.lower() != "m"):
                titled, k = True, j
        end = None
        w = word(k)
        if w is not None:
            after = initial(k)
            firsts = after > k or known.is_given(w)
            j = after if after > k else k + 1
            if firsts:
                for _ in range(3):  # middle initials
                    if j < n and near(j) and initial(j) > j:
                        j = initial(j)
                last = word(j) if j < n and near(j) else None
                if last is not None and len(last) > 1 and fold(last) not in _NOT_FAMILY and last.lower() not in _TITLES:
                    if known.is_family(last):
                        end = j
                    elif after == k and _capital(w) and _capital(last) and not last.isupper() and fold(w) not in _AMBIGUOUS and fold(last) not in _COMPANY:
                        end = j
                    elif after == k and titled and _capital(last):
                        end = j
                    elif after > k and _capital(last) and len(last) > 2 and (i == 0 or word(i - 1) is not None and not _capital(word(i - 1)) or tokens[i - 1][2] == ":"):
                        end = j  # an initial where a name can begin
            if end is None and known.is_family(w) and k + 2 < n and tokens[k + 1][2] == ",":
                g = word(k + 2)  # family name, given name
                if g is not None and near(k + 2) and (known.is_given(g) or initial(k + 2) > k + 2):
                    end = k + 2 if initial(k + 2) == k + 2 else initial(k + 2) - 1
            if end is None and len(w) > 2 and _capital(w) and not w.isupper() and fold(w) not in _NOT_FAMILY and k + 2 < n and tokens[k + 1][2] == ",":
                g = word(k + 2)  # the same with a family name that isn't known, where nothing else follows
                if g is not None and near(k + 2) and _capital(g) and known.is_given(g) and fold(g) not in _AMBIGUOUS and (k + 3 >= n or word(k + 3) is None):
                    end = k + 2
            if end is None and titled and len(w) > 1 and _capital(w) and fold(w) not in _NOT_FAMILY and (known.is_family(w) or known.is_given(w) or not w.isupper()):
                end = k
        if end is None:
            i += 1
            continue
        if text[tokens[end][1] : tokens[end][1] + 2] == " &" or (end + 1 < n and word(end + 1) is not None and near(end + 1) and fold(word(end + 1)) in _COMPANY and not titled and end == k):
            i += 1  # a company that bears a name
            continue
        out.append((tokens[start][0], tokens[end][1]))
        i = end + 1
    return out


# Given names that are also everyday words or months, so a family name must be known beside them.
_AMBIGUOUS = frozenset("april august faith grant grace hope iris ivy joy june jack mark may max miles noel pat ray rob rose sam sue summer violet will".split())
_COMPANY = frozenset("logistics freight energy sons ltd limited inc gmbh ag sa plc llc group bank".split())

# --- numbers and addresses --------------------------------------------------------------------------------

_EMAIL = re.compile(
    r"(?:mailto:)?(?<![\w.+%-])[A-Za-z0-9][\w.+%'-]*(?:@|\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s))[A-Za-z0-9][\w-]*(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9][\w-]*)+"
)
_MESSAGE_ID = re.compile(r"(?i)message-?id:?\s*<?$|references:?\s*<?$|in-reply-to:?\s*<?$")
_EXT = r"(?:\s?(?:,\s?)?(?:ext\.?|extension|x|Durchwahl|poste)\s?\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w.+/@#=-])(?:"
    r"tel:\+?[\d.\s()-]{7,20}\d"
    rf"|(?:\+|00)[1-9]\d{{0,2}}(?:[\s.-]?\(0\))?(?:[\s./-]?\(?\d{{1,9}}\)?){{2,6}}{_EXT}"
    rf"|\(\d{{3}}\)\s?\d{{3}}[-.\s]\d{{4}}{_EXT}"
    rf"|\d{{3}}([-.\s])\d{{3}}\1\d{{4}}{_EXT}"
    r"|0\d(?:[\s.]\d{2}){4}"
    rf"|\(?0\d{{2,4}}\)?[\s/-]\d{{3,8}}(?:[\s-]\d{{1,5}})?{_EXT}"
    r")(?![\w@/-]|\.\d)"
)
_ID = re.compile(
    r"(?<![\w./@#-])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d]"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|[A-Z]\d{3}-\d{4}-\d{4}"
    r"|\d{6}-\d{4}"
    r"|\d{8}-[A-Za-z]"
    r"|[A-Z]\d{8}|[A-Z]{2}\d{7}"
    r")(?![\w@/-]|\.\d)"
)
_LABELLED_ID = re.compile(
    r"(?i)\b(?:ssn|social security (?:no\.?|number)|national (?:id|insurance)(?: (?:no\.?|number))?|nino|ni number|tax id|tin|steuer-?id(?:nr\.?)?|steuernummer|dni|nie|nif|passport(?: (?:no\.?|number|nr\.?))?|reisepass(?:nr\.?)?|passeport(?: n[o°º]\.?)?|pasaporte(?: n[o°º]\.?)?|driver['’]?s? licen[cs]e(?: (?:no\.?|number))?|id card(?: (?:no\.?|number))?|personalausweis(?:nr\.?)?|identity (?:card|number))\s*[:#]?\s*(?=[A-Za-z -]{0,4}\d)([A-Za-z]{0,3}[ -]?\d[\d -]{4,17}\d[ -]?[A-Za-z]?)(?!\w)"
)
# What ends or begins the name of a street.
_STREET_EN = r"(?:street|road|lane|avenue|drive|court|crescent|close|way|place|square|terrace|boulevard|gardens|row|mews|grove|parade|walk|st|rd|ln|ave|dr|ct|blvd)"
_STREET_DE = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|ring|damm|steig|markt|chaussee)"
_STREET_FR = r"(?:rue|avenue|av\.|bd|boulevard|place|chemin|allée|impasse|quai|route|cours|passage|square|faubourg)"
_STREET_ES = r"(?:calle|c/|avenida|avda\.|plaza|paseo|camino|carrera|ronda|rua|travessa|via|viale|piazza|corso)"
_TOWN = r"(?:,?[ ]\d{4,5}(?:[ ][A-ZÀ-Þ][\w’'-]+(?:[ ][A-ZÀ-Þ][\w’'-]+)?)?|,[ ][A-ZÀ-Þ][\w’'-]+(?:[ ][A-ZÀ-Þ][\w’'-]+)?(?:[ ]\d{4,5})?)?"
_ADDRESS = re.compile(
    r"(?<![\w./#-])(?:"
    rf"(?i:(?:(?:flat|apt\.?|apartment|unit|suite)\s?\d{{1,4}}[a-z]?,\s*)?\d{{1,4}}[a-z]?,?\s+(?:[^\W\d_][\w’'-]*\s+){{1,4}}?{_STREET_EN})\b(?:,\s*(?:Apt|Flat|Unit|Suite)\.?\s?\d{{1,4}}[a-z]?)?{_TOWN}"
    rf"|(?:[A-ZÀ-Þ][\w’'-]*\s+){{1,4}}(?i:{_STREET_EN})\s+(?i:no\.?|nr\.?|number|#)\s*\d{{1,4}}[a-z]?{_TOWN}"
    rf"|(?i:\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+{_STREET_FR}\s+(?:(?:de la|de l[’']|du|des|de|d[’'])\s*)?)[^\W\d_][\w’'-]*(?:\s+(?:(?:de|du|des|la|le)\s+)?[A-ZÀ-Þ][\w’'-]*){{0,3}}{_TOWN}"
    rf"|[A-ZÀ-Þ][\w-]*(?i:{_STREET_DE})\s+\d{{1,4}}\s?[a-z]?\b{_TOWN}"
    rf"|(?i:am|an der|an den|auf dem|auf der|hinter dem|hinter der|unter den|in der|im|zum|zur|beim)\s+(?:[A-ZÀ-Þ][\w-]+\s+){{1,3}}\d{{1,4}}[a-z]?(?=,\s*\d{{4,5}}\b|,?\s+\d{{5}}\b|\s*$|\.\s|\.$|\s+as\b){_TOWN}"
    rf"|(?i:{_STREET_ES}\s+(?:(?:de la|de los|de las|del|de|da|do|della|del)\s+)?)[A-ZÀ-Þ][\w’'-]*(?:\s+[A-ZÀ-Þ][\w’'-]*){{0,3}},?\s+(?i:n[.ºo°]{{0,2}}\s*)?\d{{1,4}}\b{_TOWN}"
    r")"
)
_MONTH_WORD = re.compile(r"(?i)\b(?:jan|feb|mar|mär|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez)[a-zé]*\s+\d")
_ACCOUNT = re.compile(r"(?<![\w./@#-])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![\w@/-])")
_CARD = re.compile(r"(?<![\w./@#-])\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?![\w@/-]|\.\d)|(?<![\w./@#-])3[47]\d{2}([ -])\d{6}\2\d{5}(?![\w@/-]|\.\d)")
_LINK = re.compile(r"(?i)\b(?:hxxps?|https?|ftp)://\S+|/(?:srv|var|home|tmp|mnt)/\S+")
# What stands before a birth date.
_BORN = re.compile(
    r"(?i)\b(?:born|dob|d\.o\.b\.|date of birth|birth ?date|geb\.?|geboren(?: am)?|geburtsdatum|né(?:e)? le|date de naissance|nacid[oa] el|fecha de nacimiento)\s*:?\s*(?:on\s+)?"
    r"(?P<date>(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<a>\d{1,2})(?P<t>[-/.])(?P<b>\d{1,2})(?P=t)(?P<yy>\d{4}|\d{2})"
    r"|(?P<dd>\d{1,2})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?(?P<name>[^\W\d_]{3,10})\.?,?\s+(?:de\s+)?(?P<year>\d{4})|(?P<name2>[^\W\d_]{3,10})\.?\s+(?P<dd2>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<year2>\d{4}))(?!\d)"
)


def _born(m: re.Match) -> tuple[date, str] | None:
    """The day of a birth date and how such a day is written there; of numeric dates the day comes first where it can."""
    try:
        if m["y"]:
            return date(int(m["y"]), int(m["m"]), int(m["d"])), f"{{0.year:04d}}{m['s']}{{0.month:02d}}{m['s']}{{0.day:02d}}"
        if m["a"]:
            a, b, y = int(m["a"]), int(m["b"]), int(m["yy"])
            y += 0 if len(m["yy"]) == 4 else 1900 if y > 30 else 2000
            first, second = ("day", "month") if b <= 12 else ("month", "day")
            return date(y, *((b, a) if b <= 12 else (a, b))), f"{{0.{first}:02d}}{m['t']}{{0.{second}:02d}}{m['t']}{{0.year:04d}}"
        month = MONTHS.get((m["name"] or m["name2"]).lower())
        return (date(int(m["year"] or m["year2"]), month, int(m["dd"] or m["dd2"])), "{0.year:04d}-{0.month:02d}-{0.day:02d}") if month else None
    except ValueError:
        return None


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str


def find_mentions(text: str, known: NameKnowledge) -> list[Mention]:
    """Mentions in ordinary spelling, none overlapping another, in order."""
    taken: list[tuple[int, int]] = [m.span() for m in _LINK.finditer(text)] if "/" in text else []
    out: list[Mention] = []
    digits = any(c.isdigit() for c in text)

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append(Mention(a, b, kind))

    low = text.lower()
    if "@" in text or "at]" in low or "at)" in low or "at }" in low or " dot " in low or "[at" in low or "(at" in low:
        for m in _EMAIL.finditer(text):
            if _MESSAGE_ID.search(text[max(0, m.start() - 16) : m.start()]):
                taken.append(m.span())
            else:
                add(*m.span(), "email")
    if digits:
        for m in _BORN.finditer(text):
            if _born(m):
                add(*m.span("date"), BIRTH_DATE)
        for m in (*_ACCOUNT.finditer(text), *_CARD.finditer(text)):
            if checks.scheme_of(checks.compact(m[0])):
                add(*m.span(), "id_number")
        for m in _LABELLED_ID.finditer(text):
            add(*m.span(1), "id_number")
        for m in _ADDRESS.finditer(text):
            if not _MONTH_WORD.search(m[0]):
                add(*m.span(), "street_address")
        for m in _ID.finditer(text):
            if any(c in "123456789" for c in m[0]):
                add(*m.span(), "id_number")
        for m in _PHONE.finditer(text):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 20:
                open_end = m[0].endswith(")") and m[0].count("(") < m[0].count(")")
                add(m.start(), m.end() - open_end, "phone")
    for a, b in find_names(text, known):
        add(a, b, "person_name")
    return sorted(out, key=lambda m: m.start)


# --- placeholders --------------------------------------------------------------------------------------------

_NATIONAL = re.compile(r"^(?:tel:)?(?:(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})[\s.-]?(?:\(0\))?|\(?0(?=\d))?")


def _phone_pseudonym(text: str, key: bytes) -> str:
    """The national digits permuted; country code, trunk zero and extension stay, so all spellings of a number stay linked."""
    head = _NATIONAL.match(text)
    at = head.end() if head else 0
    ext = re.search(r"(?i)\s?,?\s?(?:ext\.?|extension|x|durchwahl|poste)\s?\d{1,5}$", text)
    end = ext.start() if ext else len(text)
    places = [i for i in range(at, end) if text[i].isdigit()]
    new = pseudonyms.permute_text("".join(text[i] for i in places), "0123456789", key, "phone")
    out = list(text)
    for i, c in zip(places, new):
        out[i] = c
    return "".join(out)


def placeholder(kind: str, text: str, key: bytes) -> str:
    """Typed placeholder of a mention in ordinary spelling."""
    if kind == "phone":
        shown = _phone_pseudonym(text, key)
    elif kind == "id_number":
        shown = checks.pseudonym(text, key)
    elif kind == BIRTH_DATE:
        m = _BORN.fullmatch(f"born {text}")
        day, form = _born(m)
        shown = form.format(pseudonyms.permute_date(day, key))
    elif kind == "email":
        plain = re.sub(r"\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\sat\s", "@", re.sub(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s", ".", text.lower()))
        shown = pseudonyms.tag(plain.removeprefix("mailto:"), key, kind)
    elif kind == "person_name":
        parts = [fold(w) for w in re.findall(_NAME_WORD, text)]
        shown = pseudonyms.tag(" ".join(sorted(p for p in parts if p not in _TITLES)), key, kind)
    else:
        shown = pseudonyms.tag(fold(re.sub(r"\W+", " ", text)), key, kind)
    return f"<{kind.upper()} {shown}>"


def mask(value: str | None, known: NameKnowledge, key: bytes) -> tuple[str | None, list[Mention]]:
    """The value with placeholders, and the mentions (places in the text they were put into)."""
    if not value:
        return value, []
    garbled = mojibake.read_value(value)
    text = garbled.restored if garbled.restored is not None else value
    plain, at = ordinary(text)
    found = find_mentions(plain, known)
    out, last, placed = [], 0, []
    for m in found:
        a, b = at[m.start], at[m.end - 1] + 1
        out += [text[last:a], placeholder(m.kind, plain[m.start : m.end], key)]
        placed.append(Mention(a, b, m.kind))
        last = b
    out.append(text[last:])
    return ("".join(out) if found else value), placed


KEY_SETTING = "relayscope.pii.key"
_DRAWN: dict[str, bytes] = {}  # keys of applications that set none


def key_of(spark: SparkSession) -> bytes:
    """The key that the session names; else one drawn for this application, which links values within it only."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()
    return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def mask_fields(df: DataFrame, key_col: str, fields: dict[str, Column], known: NameKnowledge, secret: bytes | None = None) -> DataFrame:
    """One row per value that ``mask`` changes: ``key_col``, field, kinds (one for each mention, in order), masked.

    Values with nothing but a birth date have no kinds.
    """
    spark = df.sparkSession
    secret = secret or key_of(spark)
    shared = spark.sparkContext.broadcast(known)
    names = list(fields)
    narrow = df.select(key_col, *[c.cast("string").alias(f"_f{i}") for i, c in enumerate(fields.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at, field, kinds, masked = [], [], [], []
            for i, name in enumerate(names):
                for k, value in enumerate(batch.column(i + 1).to_pylist()):
                    new, found = mask(value, held, secret)
                    if found:
                        at.append(k)
                        field.append(name)
                        kinds.append([m.kind for m in found if m.kind in KINDS])
                        masked.append(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(masked, pa.string())],
                names=[key_col, "field", "kinds", "masked"],
            )

    return narrow.mapInArrow(run, f"`{key_col}` {dict(narrow.dtypes)[key_col]}, field string, kinds array<string>, masked string")
