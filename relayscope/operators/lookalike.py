"""Domains that pass for trusted ones.

Each distinct domain is set against the list of trusted brands, a setting of at most ``MOST_BRANDS`` that
stands in the plan as a literal; nothing is joined or shuffled for it, and pairs that no rule can fire on go
no further than the row they are made in. Of each brand the first rule that fires counts: equal
skeleton, one or two edits, Jaro-Winkler similarity, the brand as a word of the first label. A brand's
own domain isn't a lookalike of it. Null and blank domains have no matches; repeated rows count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayscope.config import CONFUSABLE_FROM, CONFUSABLE_TO, MAX_EDITS, MAX_TOKEN_EDITS, MIN_JARO_WINKLER, MOST_BRANDS, TRUSTED_BRANDS


def normal_domain(domain: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(domain)), r"\.+$", "")


def skeleton(text: Column) -> Column:
    """Each confusable character as the Latin letter it passes for, in lower case."""
    return F.lower(F.translate(text, CONFUSABLE_FROM, CONFUSABLE_TO))


@F.pandas_udf(T.StringType())
def _idna(domains: pd.Series) -> pd.Series:
    def decode(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return text.encode("ascii").decode("idna")
        except UnicodeError:
            return None

    return domains.map(decode)


# filters on their results are not pushed below them, which would run them twice
_idna = _idna.asNondeterministic()


def decoded(domain: Column) -> Column:
    """Punycode resolved; null for other domains and for what can't be decoded."""
    return _idna(F.when(domain.contains("xn--"), domain))


def jaro_winkler_similarity(a: str, b: str) -> float:
    """Jaro similarity, above 0.7 raised by a tenth of the rest for each of up to four equal first letters."""
    if a == b:
        return 1.0
    m, n = len(a), len(b)
    if not m or not n:
        return 0.0
    reach = max(m, n) // 2 - 1
    taken = [False] * n
    hits = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hits.append(ch)
                break
    k = len(hits)
    if not k:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (b[j] for j in range(n) if taken[j]))) // 2
    jaro = (k / m + k / n + (k - moved) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def _most_similar(a: str, b: str) -> Column:
    """What ``jaro_winkler_similarity`` of two columns can be at most, by the letters they share, whatever their places."""
    m, n = F.length(a), F.length(b)
    shared = F.least(m - F.length(F.expr(f"translate({a}, {b}, '')")), n - F.length(F.expr(f"translate({b}, {a}, '')")))
    jaro = (shared / m + shared / n + 1) / 3
    prefix = F.lit(0)
    for k in range(1, 5):
        prefix = F.when((F.least(m, n) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), k).otherwise(prefix)
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


jaro_winkler = jaro_winkler.asNondeterministic()


def brand_word(mark: Column, brand_label: Column) -> Column:
    """The first word of the skeleton's first label that is the brand's, give or take an edit; null unless the label has several words."""
    words = F.filter(F.split(F.substring_index(mark, ".", 1), "[-_]"), lambda w: w != "")
    near = F.filter(words, lambda w: (F.levenshtein(w, brand_label) <= MAX_TOKEN_EDITS) & (F.length(w) >= F.length(brand_label) - 1))
    return F.when(F.size(words) > 1, F.get(near, F.lit(0)))


def brand_list(brands: list[str] | DataFrame | None) -> list[str]:
    """Brands in their order, of a table in that of their names; at most ``MOST_BRANDS``, also of a table."""
    if isinstance(brands, DataFrame):
        names = sorted(r[0] for r in brands.select(F.col(brands.columns[0]).cast("string")).where(F.col(brands.columns[0]).isNotNull()).distinct().limit(MOST_BRANDS + 1).collect())
    else:
        names = list(TRUSTED_BRANDS if brands is None else brands)
    if len(names) > MOST_BRANDS:
        raise ValueError(f"more than {MOST_BRANDS} trusted brands: call this once for each block of them")
    return names


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """Brands of a text file, one a line; list marks, quotes, blank lines and comments are left out."""
    line = F.regexp_replace(F.regexp_replace("value", r"(?:^|\s)#.*$", ""), r"^[\s'\"-]+|[\s'\"]+$", "")
    return spark.read.text(path).select(F.lower(line).alias("brand")).where("brand <> ''")


def against_brands(domains: DataFrame, domain: str, brands: list[str] | DataFrame | None = None) -> DataFrame:
    """Distinct ``domain`` with shown form, skeleton, is_punycode, and a row for each brand: position, brand."""
    names = brand_list(brands)
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(b).alias("brand"), F.lit(b.lower()).alias("plain")) for i, b in enumerate(names)])
    distinct = domains.select(normal_domain(F.col(domain)).alias("domain")).where("domain <> ''").distinct()
    shown = distinct.withColumn("is_punycode", F.col("domain").contains("xn--")).withColumn("decoded_unicode", decoded(F.col("domain"))).withColumn("shown", F.coalesce("decoded_unicode", "domain"))
    return shown.withColumn("skeleton", skeleton(F.col("shown"))).withColumn("b", F.explode(listed)).select("*", "b.position", "b.brand", F.col("b.plain").alias("brand_plain")).drop("b").where("shown <> brand_plain")


def matches(domains: DataFrame, domain: str, brands: list[str] | DataFrame | None = None) -> DataFrame:
    """domain, is_punycode, decoded_unicode, position, brand, method, detail of each match."""
    pairs = against_brands(domains, domain, brands)
    edits = F.levenshtein("shown", "brand_plain")
    ratio = F.least(F.length("shown"), F.length("brand_plain")) / F.greatest(F.length("shown"), F.length("brand_plain"))
    word = brand_word(F.col("skeleton"), F.substring_index("brand_plain", ".", 1))
    tested = pairs.withColumns({"edits": edits, "word": word}).withColumn("same", F.col("skeleton") == F.col("brand_plain"))
    # the similarity can't be reached where the lengths differ too much or too few letters are shared; only what is left goes to Python
    open_ = ~F.col("same") & ~F.col("edits").between(1, MAX_EDITS) & (ratio >= 0.6) & (_most_similar("shown", "brand_plain") >= MIN_JARO_WINKLER - 1e-9)
    scored = tested.withColumn("similarity", jaro_winkler(F.when(open_, F.col("shown")), F.when(open_, F.col("brand_plain"))))
    method = (
        F.when(F.col("same"), "homoglyph_skeleton")
        .when(F.col("edits").between(1, MAX_EDITS), "levenshtein")
        .when(F.col("similarity") >= MIN_JARO_WINKLER, "jaro_winkler")
        .when(F.col("word").isNotNull(), "brand_substring")
    )
    detail = (
        F.when(F.col("method") == "homoglyph_skeleton", F.concat(F.lit("normalizes to '"), F.col("skeleton"), F.lit("'")))
        .when(F.col("method") == "levenshtein", F.concat(F.col("edits").cast("string"), F.lit(" character edit(s) away from '"), F.col("brand"), F.lit("'")))
        .when(F.col("method") == "jaro_winkler", F.concat(F.round(F.col("similarity") * 100).cast("int").cast("string"), F.lit("% Jaro-Winkler similarity to '"), F.col("brand"), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), F.col("word"), F.lit("' stands as its own word")))
    )
    return scored.withColumn("method", method).where("method is not null").withColumn("detail", detail).select("domain", "is_punycode", "decoded_unicode", "position", "brand", "method", "detail")
