"""Labelled texts as balanced, split training data, and metrics of a classifier.

Order is by a keyed digest of source and text, so it is the same on every run and cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(text: Column, source: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), source, text))


def balanced_sample(df: DataFrame, text: str, label: str, source: str, *, per_class: int = 500, seed: int = 42, least: int = 20) -> DataFrame:
    """text, label, source of the sample: texts longer than ``least``, from each source of a class an even
    quota, from each class equally many, ``per_class`` at most.

    The quotas are rank limits, which Spark applies before the shuffle too, so no source is gathered in
    one task. Null texts and labels are left out; equal texts of one source count once.
    """
    rows = df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    rows = rows.where((F.length("text") > least) & F.col("label").isNotNull()).distinct().withColumn("key", shuffled(F.col("text"), F.col("source"), seed))
    sources = rows.groupBy("label").agg(F.count_distinct("source").alias("sources"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("label", "source").orderBy("key", "text"))).where(F.col("r") <= per_class)
    quota = ranked.join(sources, "label").where(F.col("r") <= F.floor(F.lit(per_class) / F.col("sources")) + 1)
    per = quota.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("key", "text")))
    n = per.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.lit(per_class), F.min("n")).alias("n"))
    return per.join(n, F.col("k") <= F.col("n")).select("text", "label", "source", "key")


def split(sample: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``sample`` with ``part``: train, validation or test. A sample is of bounded size, so one task may order it."""
    order = Window.orderBy("key", "label", "text")
    placed = sample.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    a = F.floor(F.col("n") * train)
    part = F.when(F.col("i") <= a, "train").when(F.col("i") <= a + F.floor(F.col("n") * validation), "validation").otherwise("test")
    return placed.withColumn("part", part).drop("i", "n")


def write_parts(parts: DataFrame, folder: str) -> None:
    """The parts of ``split`` as CSV with a header, one folder each, in their shuffled order."""
    for name in ("train", "validation", "test"):
        rows = parts.where(F.col("part") == name).orderBy("key", "label", "text").select("text", "label")
        rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def metrics(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """accuracy, precision, recall, f1; shares of nothing are 0. Rows with a null on either side don't count."""
    both = df.select(truth.cast("int").alias("t"), said.cast("int").alias("p")).where("t is not null and p is not null")
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    c = both.agg(F.count_if(F.expr("t = 1 and p = 1")).alias("tp"), F.count_if(F.expr("t = 0 and p = 1")).alias("fp"), F.count_if(F.expr("t = 1 and p = 0")).alias("fn"), F.count_if(F.expr("t = p")).alias("right"), F.count(F.lit(1)).alias("n"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(F.round(share(F.col("right"), F.col("n")), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), 6).alias("f1"))
