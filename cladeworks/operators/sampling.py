"""Samples and orders that depend on a seed and the key, not on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored
from .seeds import seeded
from .similarity import Space, nearest, pieces  # noqa: F401
from .ranges import running_before


def sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in seeded order: a top-n, not a sort of all rows."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def stratified(df: DataFrame, strata: list[str], key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows of each stratum, by SHA-256 of seed, stratum and key."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in [*strata, key]]), 256)
    return df.withColumn("stratum_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).filter(F.col("stratum_rank") <= most)


def queue(df: DataFrame, key: str, hosts: int, seed: str) -> DataFrame:
    """(key, host): a partition of the keys over hosts, by hash, so it needs no global order."""
    return df.select(key, F.pmod(F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("bigint"), F.lit(hosts)).alias("host"))


#: Candidates that one pass over the items brings to the driver.
CANDIDATES = 1024


def farthest_points(items: DataFrame, n: int, seed: str = "20260721", bits: int | None = None, places: int = 6) -> DataFrame:
    """(pick, id, distance): greedy farthest-point picks from (id, vector), by cosine distance or, with ``bits``, by Tanimoto distance over set bits.

    A pass gives each item its distance to the nearest pick so far and keeps the farthest CANDIDATES of all.
    Distances only fall as picks are added: while the farthest candidate comes before the last one of the
    pass, no item that was left out can come before it, so it is the next pick, and only candidates need new
    distances. The items are read once a pass and never written again. Ties go to the least id; a vector
    without length has distance 1 to all; an id is picked once, and fewer than n ids are all picked.
    """
    spark = items.sparkSession
    space = Space(bits)
    items = items.select("id", "vector").dropna(subset=["id"])
    first = items.orderBy(seeded(seed, "id"), "id").limit(1).toPandas()
    if first.empty:
        return spark.createDataFrame([], "pick int, id bigint, distance double")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in pieces(frames):
            yield pd.DataFrame({"id": f["id"].to_numpy(), "packed": space.pack(space.rows(f["vector"]))})

    packed = stored(items.mapInPandas(pack, "id bigint, packed binary"))
    picks: list[tuple[int, int, float | None]] = [(0, int(first["id"].iat[0]), None)]
    chosen = space.rows(first["vector"])

    def far(m: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.round(1 - space.similarity(m, to), places).min(1)

    while len(picks) < n:
        to, taken = chosen, np.array([p[1] for p in picks])

        def farthest(frames: Iterator[pd.DataFrame], to=to, taken=taken) -> Iterator[pd.DataFrame]:
            best = None
            for f in frames:
                f = f[~f["id"].isin(taken)].copy()
                f["distance"] = [*np.concatenate([far(space.unpack(f["packed"].iloc[k : k + 512]), to) for k in range(0, len(f), 512)])] if len(f) else []
                best = f if best is None else pd.concat([best, f])
                best = best.sort_values(["distance", "id"], ascending=[False, True]).head(CANDIDATES)
            if best is not None and len(best):
                yield best

        found = packed.mapInPandas(farthest, "id bigint, packed binary, distance double").orderBy(F.desc("distance"), "id").limit(CANDIDATES).toPandas()
        if found.empty:
            break
        last = None if len(found) < CANDIDATES else (-found["distance"].iat[-1], found["id"].iat[-1])
        ids, distance, m = found["id"].to_numpy(), found["distance"].to_numpy().copy(), space.unpack(found["packed"])
        live = np.ones(len(ids), bool)
        while len(picks) < n and live.any():
            rows = np.flatnonzero(live)
            at = rows[np.lexsort((ids[rows], -distance[rows]))[0]]
            if last is not None and (-distance[at], ids[at]) > last:
                break
            picks.append((len(picks), int(ids[at]), float(distance[at])))
            chosen = np.concatenate([chosen, m[at : at + 1]])
            live &= ids != ids[at]
            distance = np.minimum(distance, far(m, m[at : at + 1]))
    return spark.createDataFrame(picks, "pick int, id bigint, distance double")


def ordered_queue(df: DataFrame, key: str, hosts: int, host: int, seed: str, most: int | None = None) -> DataFrame:
    """(key, ord): the keys in seeded order, numbered from 0; of these the ones whose number falls to ``host``, the first ``most`` of them.

    Numbers come from running counts over ranges of the order, so no task sees all keys.
    """
    keys = df.select(key).withColumn("one", F.lit(1).cast("bigint"))
    numbered = running_before(keys, [seeded(seed, key), F.col(key)], "one").select(key, F.col("before").alias("ord"))
    own = numbered.filter(F.col("ord") % hosts == host)
    return own if most is None else own.orderBy("ord").limit(most)


def first_examples(df: DataFrame, bad: Column, order: list[str], most: int = 10) -> DataFrame:
    """The first ``most`` rows that are bad, in order: a top-n, not a sort."""
    return df.filter(bad).orderBy(*order).limit(most)
