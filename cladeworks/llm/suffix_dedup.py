"""Removal of long repeated substrings with suffix arrays.

A byte goes if some string of ``LENGTH`` bytes over it also starts elsewhere. Sorting every suffix of a
corpus would cost far more than reading it, so suffix arrays are built over what can repeat at all:

1. Every window of LENGTH bytes has an anchor, the least hashed gram inside it. Equal windows have
   equal anchors, so windows are compared only where anchors are equal. Neighbouring windows with one
   anchor form a run. An anchor gram that occurs once has no repeated window and is left out.
2. Runs of one text, at the same place from their anchor, are told by a hash. Where there are several,
   the first and the last of them enter the arrays, dealt to shards by the document of the first, so that
   neighbouring runs make one stretch of text. A run that is alone enters with all other runs of its
   anchor, one of each text, dealt to shards by anchor.
3. Each shard sorts the suffixes of its texts by Larsson-Sadakane refinement, takes Kasai's common
   prefixes, and finds which windows have an equal neighbour. Nothing is removed but what these arrays
   find; it goes from every document that has the run.
4. An anchor with many runs is split over several shards. Each gives one window of every class, in the
   order of its suffix array; these are merged by ranges of their bytes: each shard's windows are looked up in
   the others' order by binary search, byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .runtime import arrow_session, blocks, discard, stored, text_buffers
from .suffix_array import common_prefixes, suffix_array

#: Bytes of a repeated string, and of the grams that anchors are chosen among.
LENGTH, GRAM = 200, 48
#: Different runs of one anchor in one shard, about; more are split over shards.
SHARD_RUNS = 64
#: Bytes of text that a shard holds before it is sorted; what is dealt to it by one key stays whole, so a
#: document's stretches are dealt by its number and these many bytes of it.
SHARD_BYTES = 1 << 21
#: Windows that one step of the merge looks up at once.
MERGE_ROWS = 1 << 16
#: Bytes of runs, or of intervals, that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Window starts that one numpy pass handles; its arrays stay in a core's cache.
SECTION = 1 << 18

_byte_values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window start (from the text's start), anchor hash, run hash."""
    found: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for base in range(0, max(len(data) - length + 1, 0), SECTION):
        part = data[base : base + SECTION + length - 1]
        up, down = tc.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte_values[part] * up[:-1], out=sums[1:])
        grams = tc.mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        # The hash's upper bits, then the place: the least value is the leftmost of the least hashes.
        least = (grams & ~np.uint64((1 << 22) - 1)) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        starts = len(part) - length + 1
        anchor = (np.minimum(least[:starts], least[width - size : width - size + starts]) & np.uint64((1 << 22) - 1)).astype(np.int64)
        doc = owner[base : base + len(part)]
        whole = doc[:starts] == doc[length - 1 :]
        new = np.ones(starts, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:starts] != doc[: starts - 1]) | ~whole[:-1]
        head = np.flatnonzero(new & whole)
        if not len(head):
            continue
        stop = np.append(np.flatnonzero(new | ~whole), starts)
        tail = stop[np.searchsorted(stop, head, "right")] - 1
        at = anchor[head]
        text = (sums[tail + length] - sums[head]) * down[head]
        place = (at - head).astype(np.uint64) * np.uint64(1 << 32) + (tail - head).astype(np.uint64)
        run = tc.mix(tc.mix(text) ^ (place * np.uint64(0x9E3779B97F4A7C15)))
        first = offsets[doc[head]] - base
        found.append((doc[head], head - first, tail - first, grams[at].astype(np.int64), run.astype(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def runs_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all documents of (key, text)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            doc, first, last, anchor, run = anchored_runs(*text_buffers(part.column("text")), length, gram)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(doc)), pa.array(first), pa.array(last), pa.array(anchor), pa.array(run)], ["key", "first", "last", "anchor", "run"])

    return docs.mapInArrow(runs, "key bigint, first bigint, last bigint, anchor bigint, run bigint")


def repeated_windows(texts: list[bytes], spans: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of a shard equal another; ``spans`` has rows of (first window, number of windows) for each text.

    Returns each text's start in the shard, a flag for every place of it, and the windows in suffix
    order: their text, their place in it, and the number of their class.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    s = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int16) + 1
    s[begin + sizes - 1] = 0
    sa, rank = suffix_array(s, length)
    lcp = common_prefixes(s, sa, length, rank=rank)
    edge = np.zeros(len(s) + 1, np.int32)
    first = np.concatenate([own[:, 0] + b for own, b in zip(spans, begin.tolist(), strict=True)])
    np.add.at(edge, first, 1)
    np.add.at(edge, first + np.concatenate([own[:, 1] for own in spans]), -1)
    window = np.cumsum(edge[:-1]) > 0
    at = np.flatnonzero(window[sa])
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        # The common prefix of two suffixes is the least of those between them.
        least = np.minimum.reduceat(lcp, at[:-1] + 1)
        if at[-1] + 1 < len(lcp):
            least[-1] = lcp[at[-2] + 1 : at[-1] + 1].min()
        same[1:] = least >= length
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    flag = np.zeros(len(s), bool)
    flag[sa[at[repeated]]] = True
    owner = np.searchsorted(begin, sa[at], "right") - 1
    return begin, flag, owner, sa[at] - begin[owner], np.cumsum(~same)


SOLVED = "anchor bigint, run bigint, a bigint, b bigint, part int, window binary, settled boolean"


#: A stretch of text: what deals it to a shard (group, part), whether its anchor is split over shards, whether its
#: runs' windows are asked for (slot 0), and its runs, four numbers each: anchor, run, first window, number of windows.
SLICES = "group bigint, part int, split boolean, slot int, piece binary, runs binary"


def shard_windows(slices: DataFrame, length: int, shards: int) -> DataFrame:
    """What the shards' suffix arrays find about stretches (SLICES).

    A row without a window is a range of a run's windows (a to b, from the run's first) that repeat. For
    split anchors there is also a row for one window (a) of every class of equal windows, with its
    bytes and whether nothing more is asked about it.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            parts, splits, slots, pieces, blobs = zip(*held, strict=True)
            runs = [np.frombuffer(r, np.int64).reshape(-1, 4) for r in blobs]
            begin, flag, owner, place, kind = repeated_windows(list(pieces), [r[:, 2:] for r in runs], length)
            # Ends of ranges: where the flag changes, or a new run begins.
            every = np.concatenate(runs)
            first = every[:, 2] + np.repeat(begin, [len(r) for r in runs])
            asked = np.repeat(np.array(slots) == 0, [len(r) for r in runs])
            part = np.repeat(np.array(parts), [len(r) for r in runs])
            order = np.argsort(first)
            open_at = np.repeat(first - (np.cumsum(every[:, 3]) - every[:, 3]), every[:, 3]) + np.arange(every[:, 3].sum())
            of_run = np.repeat(np.arange(len(every)), every[:, 3])
            keep = flag[open_at] & asked[of_run]
            open_at, of_run = open_at[keep], of_run[keep]
            new = np.append(True, (np.diff(open_at) != 1) | (of_run[1:] != of_run[:-1])) if len(open_at) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tail = np.append(head[1:] - 1, len(open_at) - 1) if len(head) else head
            r = of_run[head]
            columns = [every[r, 0], every[r, 1], open_at[head] - first[r], open_at[tail] - first[r], part[r]]
            windows, settled = pa.nulls(len(r), pa.binary()), [None] * len(r)
            if any(splits):
                # One window of every class that a split anchor's stretch has, whichever stretch comes first.
                one = np.flatnonzero(np.array(splits)[owner])
                one = one[np.diff(kind[one], prepend=0) > 0]
                where = begin[owner[one]] + place[one]
                r = order[np.searchsorted(first[order], where, "right") - 1]
                at = where - first[r]
                columns = [np.concatenate([c, more]) for c, more in zip(columns, (every[r, 0], every[r, 1], at, at, part[r]), strict=True)]
                flat = np.frombuffer(b"\x00".join(pieces), np.uint8)
                own = np.lib.stride_tricks.sliding_window_view(flat, length)[where] if len(where) else np.zeros((0, length), np.uint8)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(where), [None, pa.py_buffer(own.tobytes())])
                windows = pa.concat_arrays([windows, fixed.cast(pa.binary())])
                settled += (flag[where] | ~asked[r]).tolist()
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c).cast(k) if isinstance(c, np.ndarray) else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip([*columns, windows, settled], kinds, strict=True)], ["anchor", "run", "a", "b", "part", "window", "settled"])

        # Rows come sorted by group and part: a shard is cut where these change, once it has text enough.
        last, known = None, set()
        for batch in batches:
            for group, part, split, slot, piece, runs in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "split", "slot", "piece", "runs")), strict=True):
                if (group, part) != last:
                    last, known = (group, part), set()
                    if size > SHARD_BYTES:
                        yield settle()
                        held, size = [], 0
                if (slot, runs[:16]) in known:  # a repeated row of another task
                    continue
                known.add((slot, runs[:16]))
                held.append((part, split, slot, piece, runs))
                size += len(piece)
        if held:
            yield settle()

    return slices.repartition(shards, "group", "part").sortWithinPartitions("group", "part").mapInArrow(solve, SOLVED)


def merged_shards(windows: DataFrame, shards: int) -> DataFrame:
    """(anchor, run, a, b) of windows that repeat between shards of one anchor; windows: rows of ``shard_windows`` with a window.

    Ranges of windows are brought together in order and read in bounded steps. In each, every window is looked up
    once in the order that all shards have together: as many comparisons of bytes as a binary search has, however
    many shards there are.
    """

    def look(value: np.ndarray, part: np.ndarray, asked: np.ndarray) -> np.ndarray:
        # Equal windows stand together; some other shard has a window if the first and the last part of its class differ.
        at = np.searchsorted(value, value)
        head = np.flatnonzero(at == np.arange(len(at)))
        several = np.minimum.reduceat(part, head) != np.maximum.reduceat(part, head)
        return asked & np.repeat(several, np.diff(np.append(head, len(at))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "run", "a", "b"]
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            # A last byte keeps numpy from dropping zeros before it.
            _, offsets, data = whole.column("window").cast(pa.large_binary()).buffers()
            ends = np.frombuffer(offsets, np.int64)[: len(whole) + 1]
            own = np.ones((len(whole), int(ends[1] - ends[0]) + 1), np.uint8)
            own[:, :-1] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(whole), -1)
            value = own.view(f"S{own.shape[1]}")[:, 0]
            # The last window may go on in the next batch: one row a shard has it.
            stop = len(whole) if last else int(np.searchsorted(value, value[-1]))
            part, asked = whole.column("part").to_numpy()[:stop], ~whole.column("settled").to_numpy(zero_copy_only=False)[:stop]
            found = look(value[:stop], part, asked) if stop else np.zeros(0, bool)
            return whole.slice(0, stop).select(names).filter(pa.array(found)), whole.slice(stop)

        most = MERGE_ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < most:
                continue
            out, rest = settle(False)
            yield out
            held, size = [rest], rest.num_rows
            # A class larger than a step is not read again with every batch.
            most = max(MERGE_ROWS, 2 * size)
        if size:
            yield settle(True)[0]

    # Ranges are cut between windows, so that equal ones meet. Equal windows have one anchor.
    return windows.repartitionByRange(shards, "window").sortWithinPartitions("window").mapInArrow(merge, "anchor bigint, run bigint, a bigint, b bigint")


def sized(small: DataFrame, size: int) -> DataFrame:
    """Marked for broadcast if its measured bytes allow it; else a shuffle joins it."""
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """(key, intervals) of documents with repeated strings, for rows of (key, text); intervals are distinct and may overlap.

    Rows with one key must have one text; each such row is a document of its own.
    """
    spark = arrow_session(docs.sparkSession)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = stored(runs_of(docs, length, gram))
    # Stored first: with plain exchanges on both sides, the join can split an anchor that very many runs have.
    again = stored(runs.groupBy("anchor").agg(F.count("*").alias("n_anchor")).filter("n_anchor > 1").select("anchor"))
    near = stored(runs.join(again, "anchor"))
    discard(runs, again)
    one = F.struct("key", "first", "last")
    by_run = stored(near.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(one).alias("least"), F.max(one).alias("most")))
    # Anchors of runs that are alone and may share windows with others.
    kinds = stored(by_run.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("alone")).filter("kinds > 1 and alone > 0").select("anchor", "kinds"))
    wide = F.col("kinds") > shard_runs
    part = F.when(wide, F.pmod(F.xxhash64("run"), F.ceil(F.col("kinds") / shard_runs))).otherwise(0).cast("int")
    mixed = by_run.join(kinds, "anchor").select("anchor", "run", F.col("anchor").alias("group"), part.alias("part"), wide.alias("split"), (F.col("n") > 1).cast("int").alias("slot"), F.col("least").alias("at"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.col("least").alias("at")), F.struct(F.lit(1).alias("slot"), F.col("most").alias("at"))))
    again = by_run.filter("n > 1").select("anchor", "run", F.col("least.key").alias("group"), F.floor(F.col("least.first") / SHARD_BYTES).cast("int").alias("part"), F.lit(False).alias("split"), both.alias("s")).select("anchor", "run", "group", "part", "split", "s.slot", "s.at")
    listed = stored(mixed.unionByName(again).groupBy("at.key").agg(F.collect_list(F.struct("group", "part", "slot", "at.first", "at.last", "anchor", "run", "split")).alias("runs")))
    size = listed.agg(F.count("*") * 48 + F.sum(F.size("runs")) * 64).first()[0] or 0
    slices = stored(sliced(docs.join(sized(listed, size), "key"), length))
    discard(by_run, listed)
    solved = stored(shard_windows(slices, length, shards))
    discard(slices)
    inside = solved.filter("window is null").select("anchor", "run", "a", "b")
    if not kinds.filter(wide).isEmpty():
        inside = inside.unionByName(merged_shards(solved.filter("window is not null"), shards))
    inside = stored(inside)
    found = near.select("key", "first", "anchor", "run").join(inside, ["anchor", "run"]).select("key", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") + length).alias("stop"))
    # Rows with one key give the same intervals: a set holds them once.
    out = stored(found.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("intervals")))
    discard(near, kinds, solved, inside)
    return out


def sliced(texts: DataFrame, length: int) -> DataFrame:
    """The listed runs' texts as stretches (SLICES): runs of one group whose texts overlap make one. Rows with one key give theirs once a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in blocks(batches):
            rows = []
            lists = batch.column("runs")
            values = lists.flatten()
            group, part, slot, first, last, anchor, run, split = (values.field(i).to_numpy(zero_copy_only=False) for i in range(8))
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
            for d, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"), strict=True)):
                if key in given:
                    continue
                if len(given) >= 1_000_000:
                    given.clear()
                given.add(key)
                raw = text.as_buffer().to_pybytes()
                own = np.arange(bounds[d], bounds[d + 1])
                own = own[np.lexsort((first[own], slot[own], part[own], group[own]))]
                g, p, t, a, b = group[own], part[own], slot[own], first[own], last[own]
                new = np.append(True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (t[1:] != t[:-1]) | (a[1:] > b[:-1] + length))
                head = np.flatnonzero(new)
                start = a[head]
                runs = np.stack([anchor[own], run[own], a - np.repeat(start, np.diff(np.append(head, len(own)))), b - a + 1], 1).astype(np.int64)
                for i, j, x in zip(head.tolist(), [*head[1:].tolist(), len(own)], start.tolist(), strict=True):
                    rows.append((int(g[i]), int(p[i]), bool(split[own[i]]), int(t[i]), raw[x : int(b[j - 1]) + length], runs[i:j].tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["group", "part", "split", "slot", "piece", "runs"])

    return texts.select("key", "text", "runs").mapInArrow(cut, SLICES)


def together(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document in order, with those that overlap or touch made one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    # Every document's intervals lie above those of the documents before it.
    base = doc * (int(stop.max()) + 1)
    most = np.maximum.accumulate(stop[order] + base)
    head = np.flatnonzero(np.append(True, start[1:] + base[1:] > most[:-1]))
    return doc[head], start[head], (most - base)[np.append(head[1:] - 1, len(doc) - 1)]


def joined(intervals: list[dict] | None) -> list[tuple[int, int]]:
    """Intervals of one document in order, with those that overlap or touch made one."""
    own = np.array([(x["start"], x["stop"]) for x in intervals or []], np.int64).reshape(-1, 2)
    _, start, stop = together(np.zeros(len(own), np.int64), own[:, 0], own[:, 1])
    return list(zip(start.tolist(), stop.tolist(), strict=True))


RESULT = "doc_id bigint, text string, intervals array<struct<start:bigint,stop:bigint>>, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_runs: int = SHARD_RUNS, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and intervals (bytes that go).

    With ``with_text`` also ``kept``, the bytes that stay, end to end (a cut may fall inside a
    character). Null texts are empty and lose nothing, as do texts shorter than ``length``; repeated rows
    are documents of their own and so lose all that a string of ``length`` covers; an empty table
    gives an empty result; columns besides doc_id and text are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    cut = repeated_intervals(docs.select("key", "text"), length, gram, shard_runs)
    cut = sized(cut, cut.agg(F.count("*") * 48 + F.sum(F.size("intervals")) * 32).first()[0] or 0)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            data, offsets = text_buffers(part.column("text"))
            raw, ends = memoryview(data), offsets.tolist()
            lists = part.column("intervals")
            own = lists.flatten()
            doc, start, stop = together(np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy()), own.field("start").to_numpy(), own.field("stop").to_numpy())
            spans = np.bincount(doc, minlength=len(lists))
            bounds = np.concatenate([[0], np.cumsum(spans)])
            gone = np.concatenate([[0], np.cumsum(stop - start)])[bounds]
            # What stays of a document: from its start or a span's stop to the next span's start or its end.
            to, after = (start + offsets[doc]).tolist(), (stop + offsets[doc]).tolist()
            digests, kept = [], []
            for i, (k, m) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                pieces = [raw[x:y] for x, y in zip([ends[i], *after[k:m]], [*to[k:m], ends[i + 1]], strict=True)]
                rest = pieces[0] if len(pieces) == 1 else b"".join(pieces)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(bytes(rest) if with_text else None)
            kind = lists.type
            merged = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], fields=list(kind.value_type))
            merged = type(lists).from_arrays(pa.array(bounds, pa.int64() if pa.types.is_large_list(kind) else pa.int32(), mask=np.append(spans == 0, False)), merged, type=kind)
            columns = [part.column("doc_id"), merged, pa.array(np.diff(offsets)), pa.array(np.diff(gone)), pa.array(spans.astype(np.int64)), pa.array(digests), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "intervals", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = docs.join(cut, "key", "left").select("doc_id", "text", "intervals").mapInArrow(remove, RESULT.replace("text string, ", ""))
    return out if with_text else out.drop("kept")
