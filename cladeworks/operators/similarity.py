"""Most similar items, exactly, by pivots and the triangle inequality.

Items are dealt to the nearest of a bounded number of pivots and cut into rings by their distance to it. A
ring is a zone: its least and greatest distance, set size and common bits bound the similarity of anything
in it to a query. A query first searches the zones that promise most, then only those whose bound is not
below what it has found. Both sides are partitioned; what the driver and every task hold is the pivots and
one row for each zone, whose number does not grow with the items.

Cosine is held as the chord between unit vectors, Tanimoto as the Jaccard distance: both are metrics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import stored
from .seeds import seeded

#: Pivots at most, chosen far apart from each other among so many sampled items.
PIVOTS, SAMPLED = 64, 2048
#: Rings of a pivot.
RINGS = 32
#: Items of a block at most, and queries that meet it in one task.
BLOCK_ROWS, QUERY_ROWS = 8192, 32_768
#: Rows that are unpacked, or items that are compared with as many queries, at once: they bound a worker's memory, whatever a batch holds.
PIECE_ROWS = 512
#: Zones that every query searches first.
FIRST_ZONES = 2
#: What rounding may add to a distance.
SLACK = 1e-7


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; a null vector or one of length zero is zero."""
    width = max((len(v) for v in vectors if v is not None), default=1)
    m = np.zeros((len(vectors), max(width, 1)))
    for row, v in zip(m, vectors, strict=True):
        if v is not None:
            row[:] = np.nan_to_num(np.asarray(v, float))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def bit_rows(vectors: pd.Series, bits: int) -> np.ndarray:
    m = np.zeros((len(vectors), bits), np.float32)
    for row, own in zip(m, vectors, strict=True):
        if own is not None:
            row[np.asarray(own, int)] = 1
    return m


def pieces(frames: Iterator[pd.DataFrame], rows: int | None = None) -> Iterator[pd.DataFrame]:
    """The same rows, so many at a time."""
    rows = rows or PIECE_ROWS
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at : at + rows]


@dataclass
class Space:
    """How vectors are packed, compared and bounded. ``bits``: None for cosine."""

    bits: int | None
    pivots: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def rows(self, vectors: pd.Series) -> np.ndarray:
        return unit(vectors) if self.bits is None else bit_rows(vectors, self.bits)

    def pack(self, m: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in (m if self.bits is None else np.packbits(m.astype(bool), axis=1))]

    def unpack(self, packed: pd.Series) -> np.ndarray:
        raw = b"".join(packed)
        if self.bits is None:
            return np.frombuffer(raw, np.float64).reshape(len(packed), -1)
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(packed), -1), axis=1, count=self.bits).astype(np.float32)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = (a @ b.T).astype(np.float64)
        if self.bits is None:
            return both
        either = a.sum(1, dtype=np.float64)[:, None] + b.sum(1, dtype=np.float64) - both
        return both / np.where(either == 0, 1, either)

    def distance(self, similarity: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * similarity, 0)) if self.bits is None else 1 - similarity

    def nearness(self, distance: np.ndarray) -> np.ndarray:
        """The similarity at a distance."""
        return 1 - distance * distance / 2 if self.bits is None else 1 - distance

    @property
    def reach(self) -> float:
        return 2.0 if self.bits is None else 1.0

    def bounds(self, q: np.ndarray, zones: Zones) -> np.ndarray:
        """The greatest similarity that each query may have to anything in each zone."""
        if not len(zones.cell):
            return np.zeros((len(q), 0))
        to_pivot = self.distance(self.similarity(q, self.pivots))[:, zones.cell]
        least = np.maximum(np.maximum(to_pivot - zones.most, zones.least - to_pivot) - SLACK, 0)
        bound = self.nearness(least)
        if self.bits is not None:
            size = q.sum(1, dtype=np.float64)[:, None]
            # So many bits may be shared: those that anything in the zone has, and no more than its largest set.
            shared = np.minimum((q @ zones.union.T).astype(np.float64), zones.largest)
            either = np.maximum(size + np.maximum(zones.smallest, shared) - shared, 1)
            bound = np.minimum(bound, shared / either)
        return bound


@dataclass
class Zones:
    cell: np.ndarray
    ring: np.ndarray
    n: np.ndarray
    least: np.ndarray
    most: np.ndarray
    smallest: np.ndarray
    largest: np.ndarray
    union: np.ndarray
    block: np.ndarray  # the first of a zone's blocks
    parts: np.ndarray  # how many blocks it is spread over

    @property
    def code(self) -> np.ndarray:
        return self.cell * RINGS + self.ring


def far_apart(m: np.ndarray, space: Space) -> np.ndarray:
    """Rows each of which is farthest from those before it."""
    if not len(m):
        return m
    chosen = [0]
    far = space.distance(space.similarity(m, m[:1]))[:, 0]
    while len(chosen) < PIVOTS and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, space.distance(space.similarity(m, m[chosen[-1:]]))[:, 0])
    return m[chosen]


PLACED = "id bigint, packed binary, cell int, ring int, radius double, size int"


def placed(items: DataFrame, space: Space) -> DataFrame:
    """Items in their rings. Vectors without length are left out: they are like nothing."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in pieces(frames):
            m = space.rows(f["vector"])
            some = np.abs(m).sum(1) > 0
            m, ids = m[some], f["id"].to_numpy()[some]
            if len(m):
                d = space.distance(space.similarity(m, space.pivots))
                cell = d.argmin(1)
                radius = d[np.arange(len(m)), cell]
                ring = np.minimum((radius / space.reach * RINGS).astype(np.int32), RINGS - 1)
                yield pd.DataFrame({"id": ids, "packed": space.pack(m), "cell": cell, "ring": ring, "radius": radius, "size": 0 if space.bits is None else m.sum(1).astype(np.int32)})

    return stored(items.select("id", "vector").mapInPandas(place, PLACED))


def zones_of(items: DataFrame, space: Space) -> Zones:
    """One row for each zone: PIVOTS * RINGS at most. Small neighbours share a block, a large zone has several."""
    stats = sorted(tuple(r) for r in items.groupBy("cell", "ring").agg(F.count("*"), F.min("radius"), F.max("radius"), F.min("size"), F.max("size")).collect())
    cols = [np.array(c) for c in zip(*stats, strict=True)] if stats else [np.zeros(0, int) for _ in range(7)]
    union = np.zeros((len(stats), space.bits or 0), np.float32)
    if space.bits is not None and stats:
        at = {(c, r): i for i, (c, r, *_) in enumerate(stats)}

        def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for f in frames:
                m = np.frombuffer(b"".join(f["packed"]), np.uint8).reshape(len(f), -1)
                for key, rows in f.groupby(["cell", "ring"]).indices.items():
                    own = np.bitwise_or.reduce(m[rows], axis=0)
                    held[key] = held[key] | own if key in held else own
            if held:
                yield pd.DataFrame({"cell": [k[0] for k in held], "ring": [k[1] for k in held], "packed": [v.tobytes() for v in held.values()]})

        parts = items.select("cell", "ring", "packed").mapInPandas(merged, "cell int, ring int, packed binary")
        both = parts.groupBy("cell", "ring").applyInPandas(lambda f: next(merged(iter([f]))), "cell int, ring int, packed binary")
        for r in both.collect():
            union[at[r["cell"], r["ring"]]] = np.unpackbits(np.frombuffer(r["packed"], np.uint8), count=space.bits)
    block, parts_, now, room = [], [], -1, 0
    for n in cols[2].tolist():
        need = -(-n // BLOCK_ROWS)
        if need > 1 or n > room:
            now += 1
            room = BLOCK_ROWS if need == 1 else 0
        block.append(now)
        parts_.append(need)
        now += need - 1
        room -= n if need == 1 else 0
    return Zones(*cols, union, np.array(block, int), np.array(parts_, int))


FOUND = "query_id bigint, item_id bigint, similarity double, compared bigint"
SENT = "id bigint, packed binary, block bigint, zones array<int>"


def sent(queries: DataFrame, space: Space, zones: Zones, first: bool, slack: float) -> DataFrame:
    """SENT: each query once for every block that holds a zone it has to search, and which zones these are.

    The first search takes a query's ``lead``, the second all other zones whose bound is not below ``best`` by more than slack.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames, 256):
            go = np.zeros((len(part), len(zones.cell)), bool)
            for row, own in zip(go, part["lead"], strict=True):
                row[np.asarray(own, int)] = True
            if not first:
                go = ~go & (space.bounds(space.unpack(part["packed"]), zones) >= part["best"].to_numpy()[:, None] - slack)
            row, zone = np.nonzero(go)
            n = zones.parts[zone]
            turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row, block, zone = np.repeat(row, n), np.repeat(zones.block[zone], n) + turn, np.repeat(zone, n)
            order = np.lexsort((zone, block, row))
            row, block, zone = row[order], block[order], zone[order]
            head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            end = np.append(head[1:], len(row))
            for at in range(0, len(head), BLOCK_ROWS):  # a query may go to very many blocks
                own, last = head[at : at + BLOCK_ROWS], end[at : at + BLOCK_ROWS]
                kept = part.iloc[row[own]]
                yield pd.DataFrame({"id": kept["id"].to_numpy(), "packed": kept["packed"].to_numpy(), "block": block[own], "zones": pd.Series([zone[x:y].astype(np.int32) for x, y in zip(own, last, strict=True)], dtype=object)})

    return queries.mapInPandas(send, SENT)


def searched(asked: DataFrame, items: DataFrame, space: Space, zones: Zones, but_itself: bool, places: int, n_queries: int) -> DataFrame:
    """FOUND: the best item of each block that a query goes to. No task holds more than QUERY_ROWS queries and BLOCK_ROWS items or about as many."""
    spread = max(1, -(-n_queries // QUERY_ROWS))
    begin, count = np.full(PIVOTS * RINGS, -1), np.ones(PIVOTS * RINGS, int)
    begin[zones.code], count[zones.code] = zones.block, zones.parts
    code = (F.col("cell") * RINGS + F.col("ring")).cast("int")
    block = F.get(F.lit(begin.tolist()), code) + F.pmod(F.xxhash64("id"), F.get(F.lit(count.tolist()), code).cast("bigint"))
    dealt = items.select("*", block.cast("bigint").alias("block"), F.explode(F.lit(list(range(spread)))).alias("turn"))
    number = {c: i for i, c in enumerate(zones.code.tolist())}

    def best(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        top, who, pairs = np.full(len(q), -np.inf), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        names = q["id"].to_numpy(np.int64)
        if len(q) and len(f):
            # Of copies of one vector only the least id can be a query's best, or the second least where the least is its own.
            f = f.sort_values("id").drop_duplicates(["packed", "id"])
            f = f[(f.groupby("packed").cumcount() < (2 if but_itself else 1)).to_numpy()]
            of = np.array([number[c] for c in (f["cell"].to_numpy(np.int64) * RINGS + f["ring"].to_numpy(np.int64)).tolist()])
            m, ids = space.unpack(f["packed"]), f["id"].to_numpy(np.int64)
            here = {z: np.flatnonzero(of == z) for z in np.unique(of).tolist()}
            for begin_ in range(0, len(q), PIECE_ROWS):
                part = q.iloc[begin_ : begin_ + PIECE_ROWS]
                vectors = space.unpack(part["packed"])
                asking: dict[int, list[int]] = {}
                for i, own in enumerate(part["zones"]):
                    for z in own.tolist():
                        asking.setdefault(z, []).append(i)
                for z in sorted(asking.keys() & here.keys()):
                    rows = np.array(asking[z])
                    own = rows + begin_
                    for at_ in range(0, len(here[z]), PIECE_ROWS):
                        cols = here[z][at_ : at_ + PIECE_ROWS]
                        s = np.round(space.similarity(vectors[rows], m[cols]), places)
                        if but_itself:
                            s[names[own][:, None] == ids[cols]] = -np.inf
                        at = s.argmax(1)
                        value, name = s[np.arange(len(rows)), at], ids[cols][at]
                        better = (value > top[own]) | ((value == top[own]) & (value > -np.inf) & (name < who[own]))
                        top[own[better]], who[own[better]] = value[better], name[better]
                        pairs[own] += len(cols)
        seen = pairs > 0
        return pd.DataFrame({"query_id": names[seen], "item_id": who[seen], "similarity": top[seen], "compared": pairs[seen]})

    left = asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")).groupBy("block", "turn")
    return left.cogroup(dealt.groupBy("block", "turn")).applyInPandas(best, FOUND)


def nearest_with_work(queries: DataFrame, items: DataFrame, but_itself: bool = False, bits: int | None = None, places: int = 6, seed: str = "pivots") -> DataFrame:
    """``nearest`` and, for each query, compared: the items that it was held against."""
    spark = items.sparkSession
    space = Space(bits)
    items, queries = items.select("id", "vector").dropna(subset=["id"]), queries.select("id", "vector").dropna(subset=["id"])
    space.pivots = far_apart(space.rows(items.orderBy(seeded(seed, "id"), "id").limit(SAMPLED).toPandas()["vector"]), space)
    some = np.abs(space.pivots).sum(1) > 0
    space.pivots = space.pivots[some]
    if not len(space.pivots):
        space.pivots = np.eye(1, max(space.pivots.shape[1], 1))
    held = placed(items, space)
    zones = zones_of(held, space)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in pieces(frames):
            m = space.rows(f["vector"])
            some = np.abs(m).sum(1) > 0
            lead = np.argsort(-space.bounds(m, zones), 1, kind="stable")[:, :FIRST_ZONES].astype(np.int32) if some.any() else np.zeros((len(m), 0), np.int32)
            yield pd.DataFrame({"id": f["id"].to_numpy(), "packed": pd.Series([p if s else None for p, s in zip(space.pack(m), some, strict=True)], dtype=object), "lead": pd.Series([x for x in lead], dtype=object)})

    asked = stored(queries.dropDuplicates(["id"]).mapInPandas(pack, "id bigint, packed binary, lead array<int>"))
    n, slack = asked.count(), 2 * 10.0**-places
    with_length = asked.filter("packed is not null")
    one = stored(searched(sent(with_length, space, zones, True, slack), held, space, zones, but_itself, places, n))
    so_far = one.groupBy(F.col("query_id").alias("id")).agg(F.max("similarity").alias("best"))
    again = with_length.join(so_far, "id", "left").withColumn("best", F.coalesce("best", F.lit(float("-inf"))))
    two = searched(sent(again, space, zones, False, slack), held, space, zones, but_itself, places, n)
    # What has no length has similarity 0 to everything: of it only the two least ids can matter, and so for a query without length.
    ids = items.select("id").distinct()
    silent = [r[0] for r in ids.join(held.select("id"), "id", "left_anti").orderBy("id").limit(2).collect()]
    least = [r[0] for r in ids.orderBy("id").limit(2).collect()]

    def beside(rows: DataFrame, others: list[int]) -> DataFrame:
        other = F.explode(F.lit(others).cast("array<bigint>") if others else F.array().cast("array<bigint>")).alias("item_id")
        found = rows.select(F.col("id").alias("query_id"), other, F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("compared"))
        return found.filter("query_id <> item_id") if but_itself else found

    every = one.unionByName(two).unionByName(beside(with_length, silent)).unionByName(beside(asked.filter("packed is null"), least))
    best = F.max(F.when(F.col("similarity") > float("-inf"), F.struct("similarity", (-F.col("item_id")).alias("minus")))).alias("m")
    out = every.groupBy("query_id").agg(best, F.sum("compared").alias("compared")).filter("m is not null")
    return out.select("query_id", (-F.col("m.minus")).alias("item_id"), F.col("m.similarity").alias("similarity"), "compared")


def nearest(queries: DataFrame, items: DataFrame, but_itself: bool = False, bits: int | None = None, places: int = 6) -> DataFrame:
    """(query_id, item_id, similarity): the most similar item of every query by cosine, or, with ``bits``, by Tanimoto over vectors that list set bits below that number; ties, at so many ``places``, go to the least item id.

    queries and items have (id, vector); a null id is no row, a null vector has no length, and vectors without
    length have similarity 0. With ``but_itself`` a query's own id is no item for it; a query without
    items has no row. Repeated ids of queries count once.
    """
    return nearest_with_work(queries, items, but_itself, bits, places).drop("compared")
