"""Hierarchical metrics, strata, gates, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stored
from .ranges import running_before


def rate(flag: Column | str) -> Column:
    """Share of true among non-null flags, to six places."""
    return F.round(F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("double")), 6)


def hierarchical_flags(df: DataFrame) -> DataFrame:
    """Adds on_path, exact, any_match, super_ok and class_ok.

    Reads predicted, candidates (array), lineage (array from the root), and the truth's levels, terminal,
    truth_super and truth_class. The last two flags are null where the truth has no such level.
    """
    levels = F.array_compact("levels")
    return df.withColumns({
        "on_path": F.coalesce(F.array_contains(levels, F.col("predicted")), F.lit(False)),
        "exact": F.coalesce(F.col("predicted") == F.col("terminal"), F.lit(False)),
        "any_match": F.coalesce(F.arrays_overlap("candidates", levels), F.lit(False)),
        "super_ok": F.when(F.col("truth_super").isNotNull(), F.coalesce(F.get("lineage", F.lit(2)) == F.col("truth_super"), F.lit(False))),
        "class_ok": F.when(F.col("truth_class").isNotNull(), F.coalesce(F.get("lineage", F.lit(3)) == F.col("truth_class"), F.lit(False))),
    })


FLAGS = ("on_path", "exact", "any_match", "super_ok", "class_ok")


def metrics(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, coverage and all rates, for all rows or for each group."""
    return flags.groupBy(*(by or [])).agg(F.count("*").alias("n"), rate(F.col("predicted").isNotNull() & (F.col("predicted") != "")).alias("coverage"), *[rate(f).alias(f) for f in FLAGS])


def hierarchical_f1(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Micro-averaged precision, recall and F1 of ancestor sets (array columns)."""
    both = F.sum(F.size(F.array_intersect(predicted, truth)))
    p, r = both / F.sum(F.size(predicted)), both / F.sum(F.size(truth))
    return df.agg(F.round(p, 6).alias("h_precision"), F.round(r, 6).alias("h_recall"), F.round(2 * p * r / (p + r), 6).alias("h_f1"))


def top_k(df: DataFrame, candidates: str, truth: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return df.agg(*[rate(F.array_contains(F.slice(candidates, 1, k), F.col(truth))).alias(f"top_{k}") for k in ks])


def confusion(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.groupBy(F.col(predicted).alias("predicted"), F.col(truth).alias("truth")).agg(F.count("*").alias("n"))


def calibration(df: DataFrame, confidence: str, correct: str, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy at or above each threshold: one aggregation, no join."""
    at = lambda t: F.col(confidence) >= t
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.avg(at(t).cast("double")).alias("c"), F.avg(F.when(at(t), F.col(correct).cast("double"))).alias("a")) for t in thresholds])
    return df.agg(cells.alias("cells")).select(F.explode("cells").alias("x")).select("x.threshold", F.round("x.c", 6).alias("coverage"), F.round("x.a", 6).alias("accuracy"))


def wilson(hits: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The 95 % interval of a share; null where n is 0."""
    p = F.try_divide(hits, n)
    mid, width = p + F.try_divide(F.lit(z * z), 2 * n), z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    base = 1 + F.try_divide(F.lit(z * z), n)
    return (mid - width) / base, (mid + width) / base


def gate(measured: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(metric, value, target, passed) of one row of metrics."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("target")) for m, t in targets.items()])
    return measured.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.value") >= F.col("r.target")).alias("passed"))


def bucket(similarity: Column) -> Column:
    """Novelty strata by similarity to the nearest training item."""
    return F.when(similarity < 0.3, "<0.3").when(similarity < 0.5, "0.3-0.5").when(similarity < 0.7, "0.5-0.7").otherwise(">=0.7")


def deltas(measured: DataFrame, expected: dict[str, float]) -> DataFrame:
    """(metric, expected, reproduced, delta)."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(e).alias("expected"), F.col(m).cast("double").alias("reproduced")) for m, e in expected.items()])
    return measured.select(F.explode(rows).alias("r")).select("r.*", F.round(F.col("r.reproduced") - F.col("r.expected"), 6).alias("delta"))


def required_lookups(hits: Column, n: Column, pool: Column | int, target: Column | int) -> dict[str, Column]:
    """What a hit rate means for a pool: expected hits, lookups until ``target`` hits, and the rate at which the pool just suffices. Null where the rate is 0 or there is none."""
    pool, target = (F.lit(x) if isinstance(x, int) else x for x in (pool, target))
    p = F.try_divide(hits, n)
    return {"expected": F.round(p * pool, 6), "lookups": F.ceil(F.round(F.try_divide(target, p), 6)), "threshold": F.round(F.try_divide(target, pool), 6)}


def frequency_bands(df: DataFrame, column: str, edges: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """Adds band: how many rows have the row's value, as '<10', '10-99' and so on. Counts are written and meet rows by a plain join, which can split a hot value."""
    counts = stored(df.groupBy(F.col(column).alias("band_value")).agg(F.count("*").alias("band_n")))
    band = F.lit(f">={edges[-1]}")
    for i in reversed(range(len(edges))):
        band = F.when(F.col("band_n") < edges[i], F.lit(f"<{edges[0]}" if i == 0 else f"{edges[i - 1]}-{edges[i] - 1}")).otherwise(band)
    return df.join(counts, F.col(column).eqNullSafe(F.col("band_value"))).select(*df.columns, band.alias("band"))


def compare_groups(df: DataFrame, flag: str, value: str) -> DataFrame:
    """One row: sizes, means and deviations of ``value`` where ``flag`` holds and where not, and the greatest distance of their distribution functions (Kolmogorov-Smirnov).

    Rows are counted by distinct value first; running counts go over those, partition by partition.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.coalesce(F.col(flag), F.lit(False)).alias("f"), F.col(value).cast("double").alias("v"))
    side = lambda f: {f"n_{f}": F.count(F.when(F.col("f") == (f == "in"), 1)), f"mean_{f}": F.round(F.avg(F.when(F.col("f") == (f == "in"), F.col("v"))), 4), f"deviation_{f}": F.round(F.stddev_samp(F.when(F.col("f") == (f == "in"), F.col("v"))), 4)}
    counts = rows.groupBy("v").agg(F.count_if("f").alias("k"), F.count_if(~F.col("f")).alias("o"))
    total = rows.agg(F.count_if("f").alias("tk"), F.count_if(~F.col("f")).alias("to"))
    run = running_before(running_before(counts, [F.col("v")], "k").withColumnRenamed("before", "bk"), [F.col("v")], "o").withColumnRenamed("before", "bo")
    gap = F.abs(F.try_divide(F.col("bk") + F.col("k"), F.col("tk")) - F.try_divide(F.col("bo") + F.col("o"), F.col("to")))
    distance = run.crossJoin(F.broadcast(total)).agg(F.round(F.max(gap), 6).alias("ks"))
    return rows.agg(*[c.alias(n) for f in ("in", "out") for n, c in side(f).items()]).crossJoin(distance)


def exact_quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: the exact quantile of each share by name, between the two nearest ranks; null without values.

    Values are counted, and ranks are running counts over ranges of them: no task or buffer holds more than one range's distinct values.
    """
    counted = df.select(F.col(column).cast("double").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    ranked = running_before(counted, [F.col("value")], "n")
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = ranked.crossJoin(F.broadcast(total))  # one row
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))
    out = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(share)
        low = at(F.floor(place))
        out.append((low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))).alias(name))
    return rows.agg(*out)
