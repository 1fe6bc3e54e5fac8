"""Time stamps in many formats as UTC instants.

Every stamp contributes all its valid readings. Where a source (a writing host, a sender's domain)
declares its date order, readings in another order have likelihood nought. For each source a mixture over
formats is fitted by expectation-maximisation: a reading's weight is its posterior under the mixture, and
the most likely reading is chosen. What stays undecided is marked ``ambiguous`` and states no instant.

The fit works on counts per source and set of possible formats, so a source that holds a third of all
rows costs a few rows there. It has no pseudo-counts: the same proportions give the same posteriors,
however many rows there are.

Defined results: null, blank, relative, incomplete and impossible stamps have status ``none`` and a null
instant, as has a numeric date that isn't one in the declared order; a stamp without zone from a source without one has status ``no_zone``. Equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.functions.stamps import readings
from relayscope.session import materialize

ORDERS = ("DMY", "MDY", "YMD")
_RESULTS = ("instant", "status", "format", "posterior")
_WORKING = ("formats", "locals", "offsets", "best")
_READ = "formats array<string>, locals array<bigint>, offsets array<int>"


def read_stamps(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with all readings of the column ``raw`` that its ``date_order`` allows: parallel arrays ``formats``, ``locals`` and ``offsets``."""
    at, declares = df.columns.index(raw), df.columns.index("date_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formats, local, offsets = [], [], []
            for text, declared in zip(batch.column(at).to_pylist(), batch.column(declares).to_pylist()):
                found = readings(text)
                if declared in ORDERS and len(found) > 0:
                    found = [r for r in found if r[0] == declared or r[0] not in ORDERS]
                formats.append([r[0] for r in found])
                local.append([r[1] for r in found])
                offsets.append([r[2] for r in found])
            arrays = [*batch.columns, pa.array(formats, pa.list_(pa.string())), pa.array(local, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "formats", "locals", "offsets"])

    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in df.dtypes), _READ])
    return df.mapInArrow(run, schema)


def em_posteriors(counts: list[tuple[tuple[str, ...], int]], rounds: int = 10_000, tolerance: float = 1e-9) -> dict[tuple[str, ...], dict[str, float]]:
    """Posterior of each format for each set of possible formats, from equal shares on. Depends on the counts' proportions only."""
    names = sorted({f for formats, _ in counts for f in formats})
    total = sum(n for _, n in counts)
    share = {f: 1 / len(names) for f in names}
    posterior: dict[tuple[str, ...], dict[str, float]] = {}
    for _ in range(rounds):
        gathered = dict.fromkeys(names, 0.0)
        for formats, n in counts:
            norm = sum(share[f] for f in formats)
            posterior[formats] = {f: share[f] / norm for f in formats}
            for f, p in posterior[formats].items():
                gathered[f] += n / total * p
        moved = max(abs(gathered[f] - share[f]) for f in names)
        share = gathered
        if moved < tolerance:
            break
    return posterior


def fit_mixtures(read: DataFrame) -> DataFrame:
    """(source, formats, best, posterior) for each set of formats that leaves a choice.

    Counts are gathered per source, as many as it has sets of formats; sources without a choice drop out
    before Python sees them.
    """
    counts = read.where(F.size("formats") > 0).groupBy("source", "formats").agg(F.count(F.lit(1)).alias("n"))
    gathered = counts.groupBy("source").agg(F.collect_list(F.struct("formats", "n")).alias("counts"), F.max(F.size("formats")).alias("most")).where("most > 1")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, counts in zip(*(batch.column(i).to_pylist() for i in range(2))):
                sets = sorted((tuple(c["formats"]), c["n"]) for c in counts)
                posterior = em_posteriors(sets)
                for formats, _ in sets:
                    if len(formats) > 1:
                        best = max(formats, key=lambda f: posterior[formats][f])
                        rows.append((source, list(formats), best, posterior[formats][best]))
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["source", "formats", "best", "posterior"])

    return gathered.select("source", "counts").mapInArrow(fit, "source string, formats array<string>, best string, posterior double")


def normalise(df: DataFrame, *, raw: str, sure: float = 0.9) -> DataFrame:
    """``df`` with ``instant``, ``status``, ``format`` and ``posterior`` for the stamps in column ``raw``.

    ``df`` also has ``source`` (who wrote it, not null), ``zone`` (IANA name, used where none is
    written) and ``date_order`` (one of ``ORDERS``; anything else declares nothing). ``sure``: the least
    posterior at which a reading counts as chosen. Columns of ``df`` that are called like one of the
    results, or like ``_WORKING``, make way for them.
    """
    read = materialize(read_stamps(df.drop(*(c for c in (*_WORKING, *_RESULTS) if c != raw)), raw), "stamps")
    fitted = fit_mixtures(read)
    joined = read.join(fitted, ["source", "formats"], "left")
    one = F.size("formats") == 1
    chosen = F.when(one, F.element_at("formats", 1)).when(F.col("posterior") >= sure, F.col("best"))
    place = F.array_position("formats", F.col("format")).cast("int")
    local, offset = F.get("locals", place - 1), F.get("offsets", place - 1)
    written = F.timestamp_micros(local - offset.cast("long") * 1_000_000)
    by_zone = F.to_utc_timestamp(F.timestamp_micros(local), F.col("zone"))
    return (
        joined.withColumn("format", chosen)
        .withColumn("instant", F.when(F.col("format").isNotNull(), F.when(offset.isNotNull(), written).when(F.col("zone").isNotNull(), by_zone)))
        .withColumn(
            "status",
            F.when(F.col("instant").isNotNull(), "stated")
            .when(F.size("formats") == 0, "none")
            .when(F.col("format").isNull(), "ambiguous")
            .otherwise("no_zone"),
        )
        .drop("formats", "locals", "offsets", "best")
    )
