"""Similarity self-join on word shingles: rare-first prefixes with length, positional and suffix filters.

Documents with the same shingle set are one node, known by a 64-bit fingerprint of the set. A node's
shingles are ordered from rare to frequent; two nodes that are similar enough share one within the
leading part, the prefix. Candidates come from equal prefix shingles in two rounds. In the first, each
shingle's nodes are held against one of them only, its centre: the node with the fewest rarer shingles
before it, which among near copies is the one that was edited least. What is found similar is merged.
In the second, nodes of different components that share a prefix shingle are held against each other where
both sizes and the shingle's places allow it: what stands behind its place bounds how large a partner may be,
and a join on ranges of sizes meets no others. So neither a group of thousands of near copies nor thousands
of different texts around one passage become all their pairs, and no link between components is lost. The suffix filter bounds the overlap by the counts of hash ranges in both
sets, in one step for the whole set and not by halving it again and again; both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textcore as tc
from .components import components
from .runtime import arrow_session, blocks, discard, stored, text_buffers

#: Words of a shingle.
SHINGLE = 5
#: Similar from 75 / 100 on: intersection against union.
SIMILAR = (75, 100)
#: Frequent shingles whose document counts set the order. All others count as equally rare and are
#: ordered by hash; any order gives the same result.
FREQUENT = 1 << 18
#: Bits of the hash by which a task remembers shingles that it has seen once.
SEEN_BITS = 25
#: Parts of the hash range that the suffix filter compares counts of: a power of two, this many at least
#: and as many as give a part PART_SIZE members at most, so that sets which share few members differ in
#: most parts however large they are.
PARTS, PART_SIZE = 128, 4
#: Rows of two 64-bit numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_NODES = 200_000
#: Documents of one shingle that meet in one group at most; a more frequent one is salted by node.
SALT_ROWS = 1 << 16


def prefix_length(n, similar: tuple[int, int] = SIMILAR):
    """Leading shingles of which similar sets share one: n less the least overlap, plus 1."""
    t, u = similar
    return n - (-(-t * n // u)) + 1


def largest_partner(n: Column, pos: Column, similar: tuple[int, int] = SIMILAR) -> Column:
    """The largest set that may be similar to one of size n if their first common shingle is at place pos of it."""
    t, u = similar
    return F.floor((F.lit(t + u) * (n - pos) - F.lit(t) * n) / F.lit(t)).cast("bigint")


#: A block of sizes is four of the next smaller ones; blocks of a level have this many sizes to its power.
RADIX = 4


def size_blocks(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the aligned blocks that make up each range from low to high, high included: few, whatever the range."""
    rows, low, high = np.arange(len(low)), low.astype(np.int64).copy(), high.astype(np.int64) + 1
    out_rows, out_keys, level = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(rows):
        for _ in range(RADIX - 1):
            at = np.flatnonzero((low < high) & (low % RADIX != 0))
            out_rows.append(rows[at]), out_keys.append((level << 40) + low[at])
            low[at] += 1
        for _ in range(RADIX - 1):
            at = np.flatnonzero((low < high) & (high % RADIX != 0))
            high[at] -= 1
            out_rows.append(rows[at]), out_keys.append((level << 40) + high[at])
        live = low < high
        rows, low, high, level = rows[live], low[live] // RADIX, high[live] // RADIX, level + 1
    return np.concatenate(out_rows), np.concatenate(out_keys)


def blocks_of(size: np.ndarray, similar: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of all blocks that a size is in, as large as a range of partners' sizes that ends at it or beyond may use."""
    t, u = similar
    out_rows, out_keys, level = [], [], 0
    # A range from n to at most u n / t that holds the size is no longer than the size times (u - t) u / t / t, and 1.
    room = size * (u - t) * u // (t * t) + 1
    at = np.arange(len(size))
    while len(at):
        out_rows.append(at), out_keys.append((level << 40) + size[at] // RADIX**level)
        level += 1
        at = at[room[at] >= RADIX**level]
    return np.concatenate(out_rows or [np.zeros(0, np.int64)]), np.concatenate(out_keys or [np.zeros(0, np.int64)])


def least_overlap(n: Column, m: Column, similar: tuple[int, int] = SIMILAR) -> Column:
    """Shingles that sets of these sizes have in common if they are similar."""
    t, u = similar
    return F.ceil(F.lit(t) * (n + m) / F.lit(t + u))


def shingle_sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of a block and each text's bounds among them."""
    data, offsets = text_buffers(part.column("text"))
    data = tc.LOWER[data]
    starts, ends, first = tc.word_spans(data, offsets, tc.SOLID)
    value, doc = tc.shingles(tc.span_hash(data, starts, ends), first, n)
    return value, np.searchsorted(doc, np.arange(part.num_rows + 1))


def fingerprint(values: np.ndarray) -> int:
    """64-bit hash of a set: a sum over its members, then mixed with its size."""
    with np.errstate(over="ignore"):
        total = tc.mix(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(values))
    return int(tc.mix(np.array([total], np.uint64)).astype(np.int64)[0])


def frequent_shingles(docs: DataFrame, n: int = SHINGLE, keep: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles over all documents, sorted by hash, and in how many documents they are.

    Each task keeps a bounded summary: a shingle is counted from its second document in the task on, as
    told by a bitmap of hashes; the summaries are added. Rare shingles may be missing, which costs order, not results.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        seen = np.zeros(1 << SEEN_BITS, bool)
        for part in blocks(batches):
            value, bounds = shingle_sets(part, n)
            own = [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
            if not own:
                continue
            k, c = np.unique(np.concatenate(own), return_counts=True)
            slot = (k >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
            again = seen[slot] | (c > 1)
            seen[slot] = True
            keys, inverse = np.unique(np.concatenate([keys, k[again]]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, c[again]]), minlength=len(keys)).astype(np.int64)
            if len(keys) > 4 * keep:
                top = np.sort(np.argpartition(-counts, keep)[:keep])
                keys, counts = keys[top], counts[top]
        if len(keys) > keep // 4:
            top = np.argpartition(-counts, keep // 4)[: keep // 4]
            keys, counts = keys[top], counts[top]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["shingle", "n"])

    found = docs.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.filter("n >= 2").orderBy(F.desc("n"), "shingle").limit(keep).toPandas()
    keys = rows["shingle"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy(np.int64)[order]


SET_ROWS = "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, parts array<tinyint>, prefix array<bigint>, salts array<int>"


def set_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row a document: its set's size, node, part counts, rare-first prefix and the salts of its shingles.

    The prefix is null where the same task has given that node's before; a document without words
    has no node. Salts are null where all are 0.
    """
    keys, counts = frequent
    mask = np.zeros(1 << 20, bool)
    mask[(keys >> np.uint64(44)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts, mask))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("parts", pa.list_(pa.int8())), ("prefix", pa.list_(pa.int64())), ("salts", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, mask = shared.value
        given: set[int] = set()
        for part in blocks(batches):
            value, bounds = shingle_sets(part, n)
            often = np.zeros(len(value), np.int64)
            near = np.flatnonzero(mask[(value >> np.uint64(44)).astype(np.int64)])
            if len(near):
                at = np.minimum(np.searchsorted(keys, value[near]), len(keys) - 1)
                often[near] = np.where(keys[at] == value[near], counts[at], 0)
            size, node, parts, prefix, salts = [], [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b:
                    size.append(0), node.append(None), parts.append(None), prefix.append(None), salts.append(None)
                    continue
                own, at = np.unique(value[a:b], return_index=True)
                key = fingerprint(own)
                size.append(len(own)), node.append(key)
                parts.append(part_counts(own))
                if key in given:
                    prefix.append(None), salts.append(None)
                    continue
                if len(given) >= 500_000:
                    given.clear()
                given.add(key)
                count = often[a:b][at]
                leading = prefix_length(len(own), similar)
                salt = None
                if count.any():
                    order = np.lexsort((own, count))[:leading]
                    own, groups = own[order], count[order] // SALT_ROWS + 1
                    if groups[-1] > 1:
                        salt = np.where(groups > 1, abs(key) % groups + 1, 0).astype(np.int32)
                prefix.append(own[:leading].astype(np.int64)), salts.append(salt)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(parts, pa.list_(pa.int8())), pa.array(prefix, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))], schema=schema)

    return docs.mapInArrow(rows, SET_ROWS)


def part_counts(members: np.ndarray) -> np.ndarray:
    """Members in each part of the hash range, 127 at most: a cap brings counts closer together, so the bound still holds."""
    bits = max(PARTS.bit_length() - 1, (-(-len(members) // PART_SIZE) - 1).bit_length())
    return np.minimum(np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 127).astype(np.int8)


def parts_apart(a: str, b: str) -> Column:
    """The sum over all parts of how far two columns of part counts differ. Where one has twice as many parts, neighbours are added first."""
    halved = lambda c: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(c), 1) - 1), lambda i: F.get(c, 2 * i).cast("int") + F.get(c, 2 * i + 1).cast("int"))
    plain = lambda c: F.transform(c, lambda x: x.cast("int"))
    at = lambda c, other: F.when(F.size(c) > F.size(other), halved(c)).otherwise(plain(c))
    return F.aggregate(F.zip_with(at(a, b), at(b, a), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """(node, members) of (node, text) rows, once a node and task."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for part in blocks(batches):
            value, bounds = shingle_sets(part, n)
            nodes, own = [], []
            for node, a, b in zip(part.column("node").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if node not in given:
                    given.add(node)
                    nodes.append(node)
                    own.append(np.unique(value[a:b]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["node", "members"])

    return texts.mapInArrow(members, "node bigint, members array<bigint>")


def similar_pairs(pairs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Those (a, b, members_a, members_b) rows whose sets are similar enough, by exact intersection."""
    t, u = similar

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("members_a"), batch.column("members_b")
            xv, yv = x.flatten().to_numpy(), y.flatten().to_numpy()
            xo, yo = np.append(0, np.cumsum(x.value_lengths().to_numpy())), np.append(0, np.cumsum(y.value_lengths().to_numpy()))
            keep = []
            for i in range(batch.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(u * common >= t * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(verify, "a bigint, b bigint")


class Join:
    """One self-join of documents; holds the tables that its steps share."""

    def __init__(self, docs: DataFrame, n: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> None:
        arrow_session(docs.sparkSession)
        self.n, self.similar = n, similar
        text = F.col("text").cast("string")
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
        frequent = frequent_shingles(self.docs, n)
        self.salted = bool(len(frequent[1])) and int(frequent[1].max()) >= SALT_ROWS
        self.rows = stored(set_rows(self.docs, frequent, n, similar))
        known = self.rows.filter("node is not null")
        self.nodes = known.groupBy("node").agg(F.min("n_shingles").alias("n"), F.min("text_hash").alias("text_hash"), F.first("parts").alias("parts"))

    def occupied(self) -> DataFrame:
        """Prefix shingles that two nodes or more have: each node's place there, and the centre to hold it against.

        A shingle with a salt is dealt to several groups, each with a centre of its own.
        """
        at = F.shiftleft(F.col("n_shingles"), 32) + F.col("pos")  # size and place in one number
        listed = self.rows.filter("prefix is not null").select("node", "n_shingles", "salts", F.posexplode("prefix").alias("pos", "shingle"))
        salt = [F.coalesce(F.get("salts", F.col("pos")), F.lit(0)).alias("salt")] * self.salted
        listed = listed.select("node", at.alias("at"), "shingle", *salt)
        group = ["shingle", "salt"] if self.salted else ["shingle"]
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = listed.repartition(parts, *group).dropDuplicates([*group, "node"])
        place = F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
        first = F.min(F.struct(place.alias("pos"), "node", "at")).alias("c")
        # A salted shingle's groups stay whatever their size: they meet each other.
        centres = placed.groupBy(*group).agg(first, F.count("*").alias("held")).filter("held > 1 or salt > 0" if self.salted else "held > 1")
        size = lambda c: F.shiftright(c, 32)
        return placed.join(centres, group).select("shingle", "node", size(F.col("at")).alias("n"), place.alias("pos"), F.col("c.node").alias("c"), size(F.col("c.at")).alias("c_n"), F.col("c.pos").alias("c_pos"), *(["salt"] if self.salted else []))

    def possible(self, n: Column, i: Column, m: Column, j: Column) -> Column:
        """Length filter, and positional filter for a first common shingle at places i and j."""
        t, u = self.similar
        return (F.lit(u) * F.least(n, m) >= F.lit(t) * F.greatest(n, m)) & (F.least(n - i, m - j) >= least_overlap(n, m, self.similar))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of distinct (a, b) pairs: suffix filter on part counts, then one verification each."""
        side = lambda s: self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("parts").alias(f"parts_{s}"), F.col("text_hash").alias(f"hash_{s}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(parts_apart("parts_a", "parts_b") <= F.col("n_a") + F.col("n_b") - 2 * least_overlap(F.col("n_a"), F.col("n_b"), self.similar))
        near = stored(near.select("a", "b", "hash_a", "hash_b"))
        wanted = stored(near.select(F.col("a").alias("node"), F.col("hash_a").alias("text_hash")).union(near.select("b", "hash_b")).distinct())
        held = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted.hint("shuffle_hash")
        # Texts with one hash differ in doc_id only: each task gives a node's set once, and one of these is taken.
        found = stored(sets_of(self.docs.select("text_hash", "text").join(held, "text_hash").select("node", "text"), self.n))
        own = lambda s: found.dropDuplicates(["node"]).select(F.col("node").alias(s), F.col("members").alias(f"members_{s}"))
        out = stored(similar_pairs(near.select("a", "b").join(own("a"), "a").join(own("b"), "b"), self.similar))
        discard(near, wanted, found)
        return out

    def roots(self) -> DataFrame:
        """(node, root) of all nodes that are not alone and not the root themselves."""
        pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        held = stored(self.occupied())
        star = lambda rows: rows.filter("node <> c").filter(self.possible(F.col("n"), F.col("pos"), F.col("c_n"), F.col("c_pos"))).select(*pair("node", "c"))
        pairs = star(held)
        if self.salted:  # centres of a salted shingle's groups are held against the first of them
            heads = held.filter("salt > 0 and node = c").select("shingle", "node", "n", "pos")
            one = heads.groupBy("shingle").agg(F.min(F.struct("pos", "node", "n")).alias("h"))
            pairs = pairs.union(star(heads.join(one, "shingle").select("node", "n", "pos", F.col("h.node").alias("c"), F.col("h.n").alias("c_n"), F.col("h.pos").alias("c_pos"))))
        tried = stored(pairs.distinct())
        first = self.links(tried)
        near = components(first, "a", "b")
        placed = stored(held.select("shingle", "node", "n", "pos", (F.col("node") == F.col("c")).alias("own")).join(near, "node", "left").select("shingle", "node", "n", "pos", "own", F.coalesce("root", "node").alias("part")))
        discard(held)
        split = stored(self.open_groups(placed))
        short, long = self.sides(split)
        more = self.met(short.filter("not main"), long).union(self.met(short.filter("main"), long.filter("not main")))
        more = stored(more.distinct().join(tried, ["a", "b"], "left_anti"))
        discard(placed, split, tried)
        if more.isEmpty():
            return near
        discard(near)
        return components(first.union(self.links(more)), "a", "b")

    def open_groups(self, placed: DataFrame) -> DataFrame:
        """Of ``placed`` (shingle, node, n, pos, own, part) the rows of shingles that several components share and some row of which may have a partner of its size or more: with far, the largest size such a partner has, and main, whether the row is in the component of the shingle's centre."""
        far = largest_partner(F.col("n"), F.col("pos"), self.similar)
        rows = placed.withColumn("far", far)
        asks = F.col("far") >= F.col("n")
        # Of a salted shingle's centres the one in the greatest component stands for all.
        groups = rows.groupBy("shingle").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.max(F.when(F.col("own"), F.col("part"))).alias("centre"), F.min(F.when(asks, F.col("n"))).alias("low"), F.max(F.when(asks, F.col("far"))).alias("high"))
        groups = stored(groups.filter("least <> most and low is not null").select("shingle", "centre", "low", "high"))
        return rows.drop("own").join(groups, "shingle").filter("n between low and high").withColumn("main", F.col("part").eqNullSafe(F.col("centre"))).drop("centre", "low", "high")

    def sides(self, split: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``split`` as the shorter of two sets, once for each block of sizes that its partners may have, and as the longer, once for each block that it is in. A pair meets in one block."""
        similar = self.similar
        columns = "shingle bigint, node bigint, n bigint, pos bigint, part bigint, main boolean, block bigint"

        def keyed(batches: Iterator[pa.RecordBatch], shorter: bool) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy()
                rows, keys = size_blocks(n, np.minimum(batch.column("far").to_numpy(), n * similar[1] // similar[0])) if shorter else blocks_of(n, similar)
                out = batch.drop_columns(["far"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(keys)], [*out.schema.names, "block"])

        own = split.select("shingle", "node", "n", F.col("pos").cast("bigint").alias("pos"), "part", "main", "far")
        short = own.filter("far >= n").mapInArrow(lambda b: keyed(b, True), columns)
        return short, own.mapInArrow(lambda b: keyed(b, False), columns)

    def met(self, short: DataFrame, long: DataFrame) -> DataFrame:
        """Pairs (a, b) of both sides that pass the length and positional filters and are of different components."""
        x, y = short.alias("x"), long.alias("y")
        apart = F.col("x.part") != F.col("y.part")
        pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block")) & apart & self.possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def result(self) -> DataFrame:
        """doc_id, text_hash, n_shingles and component_id of every document."""
        roots = self.roots()
        known = self.rows.filter("node is not null")
        # Small tables are stored before they meet a key that may be hot, so that the join can split it.
        least = stored(known.groupBy("node").agg(F.min("doc_id").alias("least")))
        linked = stored(least.join(roots.union(roots.select("root", "root")).distinct(), "node"))
        ids = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")))
        ids = stored(least.join(linked.join(ids, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")))
        full = known.select("doc_id", "text_hash", "n_shingles", "node").join(ids, "node").select("doc_id", "text_hash", "n_shingles", "component_id")
        empty = self.rows.filter("node is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
        return full.unionByName(empty)


def near_duplicates(docs: DataFrame, n: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row a document: doc_id, n_shingles (size of its set) and component_id.

    component_id is the smallest doc_id that links reach. A null or empty text has an empty set and
    is alone; a null doc_id takes part but is nobody's component_id, so a component of such rows only
    has null. Repeated rows are in one component, an empty table gives an empty result, columns besides
    doc_id and text are not read.
    """
    return Join(docs, n, similar).result().drop("text_hash")


def bounded(small: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows allow it; else a shuffle joins it."""
    return F.broadcast(small) if small.count() <= BROADCAST_NODES else small


def one_of_each(docs: DataFrame, n: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The document with the least doc_id of every component, with all its columns.

    Documents without words are alone and stay. Of rows with the same doc_id and text one stays. A row
    with a null doc_id goes if it is linked to one with a doc_id, else it stays.
    """
    found = stored(Join(docs, n, similar).result())
    mark = F.xxhash64(F.col("text").cast("string"))
    same = lambda rows: (F.col("doc_id").cast("bigint").eqNullSafe(rows["gone_id"])) & (mark == rows["gone_hash"])
    keys = lambda rows: stored(rows.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    gone = bounded(keys(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))))
    repeated = keys(found.filter("doc_id is not null").groupBy("doc_id", "text_hash").count().filter("count > 1"))
    out = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return out
    repeated = bounded(repeated)
    return out.join(repeated, same(repeated), "left_anti").unionByName(out.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id"]))
