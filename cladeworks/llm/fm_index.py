"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard's words become symbols: one for each word of the benchmark and a separator for all others, for
a phrase can only occur where every word is a benchmark word. The shard's suffix array gives the
Burrows-Wheeler transform, a wavelet matrix answers ranks, all phrases are searched backward at once,
and occurrences are located from sampled suffix positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from . import textcore as tc
from .runtime import arrow_session, blocks, stored, text_buffers
from .suffix_array import suffix_array

#: Words of a phrase.
WINDOW = 10
#: Every such text position keeps its place in the suffix array.
SAMPLE = 8
#: Bytes of training text that one index covers.
SHARD_BYTES = 1 << 22
#: Bytes of benchmark text that are searched, and broadcast, at once. A larger benchmark takes several passes.
BENCHMARK_BYTES = 8 << 20

TERMINATOR, SEPARATOR, FIRST_WORD = 0, 1, 2


class WaveletMatrix:
    """Rank and access over an integer sequence, for whole arrays of positions."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Where the symbol's occurrences before each position end, in the matrix's last level."""
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            before = ones[position]
            bit = (symbol >> (self.bits - 1 - k)) & 1
            position = np.where(bit == 1, zeros + before, position - before)
        return position

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        return self.descend(symbol, position) - self.descend(symbol, np.zeros_like(position))

    def access(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, at = np.zeros_like(position), position
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at]
            bit = ones[at + 1] - before
            symbol = (symbol << 1) | bit
            at = np.where(bit == 1, zeros + before, at - before)
        return symbol, at - self.descend(symbol, np.zeros_like(position))


class FMIndex:
    """Count and locate phrases in an integer text whose symbols are at least ``SEPARATOR``."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.append(text, TERMINATOR)
        sa, _ = suffix_array(text)
        self.tree = WaveletMatrix(text[sa - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        marked = sa % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.marked, self.kept, self.n = marked, sa[marked], len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of phrases, given right-aligned in the rows of a matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths >= width - k) & (lo < hi))
            if not len(live):
                continue
            symbol = phrases[live, k]
            known = symbol < len(self.before) - 1
            lo[live[~known]] = hi[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            base = self.before[symbol]
            start = self.tree.descend(symbol, np.zeros_like(symbol))
            lo[live], hi[live] = base + self.tree.descend(symbol, lo[live]) - start, base + self.tree.descend(symbol, hi[live]) - start
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to the nearest sampled one."""
        out, at = np.zeros(len(rows), np.int64), rows.astype(np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            done = self.marked[at]
            out[live[done]] = self.kept[self.mark_rank[at[done]]] + steps
            live, at = live[~done], at[~done]
            symbol, rank = self.tree.access(at)
            at = self.before[symbol] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct phrases of benchmark items and the items that have each."""

    vocabulary: np.ndarray  # sorted word hashes; word k is symbol FIRST_WORD + k
    filter: np.ndarray  # by the hash's top bits: whether the vocabulary has such a word
    rows: np.ndarray  # phrases, right-aligned
    lengths: np.ndarray
    item_first: np.ndarray  # phrase k has the items item_of[item_first[k]:item_first[k + 1]]
    item_of: np.ndarray
    items: list[str | None]

    @property
    def least(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


FILTER_BITS = 20


def phrases_of(rows: list[Row], window: int = WINDOW) -> Phrases:
    """Windows of items given as (item_id, text). A null text has no words."""
    data, offsets = text_buffers(pa.array([r[1] for r in rows], pa.string()))
    data = tc.LOWER[data]
    starts, ends, first = tc.word_spans(data, offsets, tc.ALNUM)
    hashes = tc.span_hash(data, starts, ends)
    vocabulary, symbol = np.unique(hashes, return_inverse=True)
    names = sorted({str(r[0]) for r in rows if r[0] is not None})
    number = {n: i for i, n in enumerate(names)}
    found: dict[tuple[int, ...], set[int]] = {}
    for i, r in enumerate(rows):
        own = (symbol[first[i] : first[i + 1]] + FIRST_WORD).tolist()
        item = -1 if r[0] is None else number[str(r[0])]
        for k in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[k : k + window]), set()).add(item)
    lengths = np.array([len(p) for p in found], np.int64)
    table = np.zeros((len(found), window), np.int64)
    for k, p in enumerate(found):
        table[k, window - len(p) :] = p
    sizes = [len(v) for v in found.values()]
    mask = np.zeros(1 << FILTER_BITS, bool)
    mask[(vocabulary >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Phrases(vocabulary, mask, table, lengths, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([i for v in found.values() for i in sorted(v)], np.int64), names)


def benchmark_parts(benchmark: DataFrame) -> int:
    """In how many parts of about BENCHMARK_BYTES of text a benchmark is searched for."""
    total = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-total // BENCHMARK_BYTES))


def benchmark_phrases(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Phrases]:
    """The benchmark's phrases, part by part: what reaches the driver at once is bounded."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = benchmark_parts(benchmark)
    for k in range(parts):
        yield phrases_of(rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect(), window)


def occurrences(hashes: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Words where phrases begin, and which phrase: all occurrences within single texts."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(phrases.lengths):
        return none, none
    near = np.flatnonzero(phrases.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes[near]), len(phrases.vocabulary) - 1)
    same = phrases.vocabulary[place] == hashes[near]
    near, symbol = near[same], place[same] + FIRST_WORD
    if not len(near):
        return none, none
    doc = np.searchsorted(first, near, "right")
    broken = np.ones(len(near), bool)
    broken[1:] = (near[1:] != near[:-1] + 1) | (doc[1:] != doc[:-1])
    run = np.cumsum(broken) - 1
    long = np.bincount(run)[run] >= phrases.least
    near, symbol, run = near[long], symbol[long], run[long]
    if not len(near):
        return none, none
    _, run = np.unique(run, return_inverse=True)
    text = np.full(len(near) + run[-1] + 1, SEPARATOR, np.int64)
    origin = np.zeros(len(text), np.int64)
    spot = np.arange(len(near)) + run
    text[spot], origin[spot] = symbol, near
    index = FMIndex(text)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return origin[index.locate(rows)], which


HITS = {"n_words": "bigint", "hits": "array<struct<first:bigint,n:bigint>>", "items": "array<string>"}


def with_hits(df: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``df``, which has a text, with n_words, hits and items of every text. Only one part of the benchmark is broadcast at a time."""
    spark = arrow_session(df.sparkSession)
    empty = {"n_words": "0L", "hits": "array()", "items": "array()"}
    df = df.withColumns({n: F.expr(f"cast({empty[n]} as {kind})") for n, kind in HITS.items()})
    held = None
    for phrases in benchmark_phrases(benchmark, window):
        if held is not None:  # the rows of the pass before are written, so that its phrases can go
            df = stored(df)
            held.destroy()
        held = spark.sparkContext.broadcast(phrases)
        df = df.mapInArrow(searcher(held), df.schema)
    return df


def search_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of benchmark phrases in every document: doc_id, text, n_words, hits and items.

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one. hits are the
    maximal runs of words inside occurrences (first word from 0, number of words), items the ids of
    items with an occurring phrase, sorted as strings. Null and empty texts have no words, repeated
    rows are searched each, items without words match nothing and items with a null id count for hits
    only. Columns besides doc_id and text are not read.
    """
    return with_hits(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window)


RUN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))


def searcher(shared):
    """The Arrow function of one pass; earlier passes' hits and items are kept."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for part in blocks(batches, limit=SHARD_BYTES):
            data, offsets = text_buffers(part.column("text"))
            data = tc.LOWER[data]
            starts, ends, first = tc.word_spans(data, offsets, tc.ALNUM)
            begin, which = occurrences(tc.span_hash(data, starts, ends), first, phrases)
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + phrases.lengths[which], -1)
            hits, items = part.column("hits").to_pylist(), part.column("items").to_pylist()
            for d, own in enumerate(hits):
                for h in own:
                    edge[first[d] + h["first"]] += 1
                    edge[first[d] + h["first"] + h["n"]] -= 1
            inside = (np.cumsum(edge) > 0)[:-1]
            doc_of = np.repeat(np.arange(len(hits)), np.diff(first))
            head = np.flatnonzero(inside & np.append(True, ~inside[:-1] | (doc_of[1:] != doc_of[:-1])) if len(inside) else inside)
            tail = np.flatnonzero(inside & np.append(~inside[1:] | (doc_of[1:] != doc_of[:-1]), True) if len(inside) else inside)
            runs = np.bincount(doc_of[head], minlength=len(hits)) if len(head) else np.zeros(len(hits), np.int64)
            added: dict[int, set[int]] = {}
            for d, p in np.unique(np.stack([doc_of[begin], which], 1), axis=0).tolist() if len(begin) else []:
                added.setdefault(d, set()).update(phrases.item_of[phrases.item_first[p] : phrases.item_first[p + 1]].tolist())
            for d, numbers in added.items():
                items[d] = sorted({*items[d], *(phrases.items[i] for i in numbers if i >= 0)})
            merged = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(head - first[:-1][doc_of[head]]) if len(head) else pa.array([], pa.int64()), pa.array(tail - head + 1)], ["first", "n"]),
            )
            for name, values in (("n_words", pa.array(np.diff(first))), ("hits", merged), ("items", pa.array(items, pa.list_(pa.string())))):
                place = part.schema.get_field_index(name)
                part = part.set_column(place, name, values.cast(part.schema.field(place).type))
            yield part

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = search_documents(docs, benchmark, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def kept_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """A text without spans of its bytes; what is left of it is cut free of white space, and of pieces without a letter, digit or non-ASCII character, and set on lines."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    pieces = [x.strip() for x in (k.decode("utf-8") for k in [*kept, raw[at:]])]
    return "\n".join(x for x in pieces if any(c.isalnum() or ord(c) > 127 for c in x))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the words of any occurrence; all columns, with n_chars, where there is one, counted anew.

    What is removed leaves a line break; beside it, white space and pieces of punctuation alone go too.
    Removal can join words to a new occurrence, so a changed text is searched again until none is left.
    Clean documents, null and empty texts stay as they are; a text that was nothing but benchmark words
    becomes empty; repeated rows are treated alike; an empty table gives an empty result.
    """
    if benchmark_parts(benchmark) > 1:
        out = by_passes(docs, benchmark, window)
    else:
        out = at_once(docs, benchmark, window)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def by_passes(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``decontaminated`` for a benchmark of several parts: hits of all parts are gathered pass by pass, then their words go at once, until there are none."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=SHARD_BYTES):
            data, offsets = text_buffers(part.column("text"))
            starts, ends, first = tc.word_spans(tc.LOWER[data], offsets, tc.ALNUM)
            texts = part.column("text").to_pylist()
            for d, hits in enumerate(part.column("hits").to_pylist()):
                if hits:
                    a, spans = int(offsets[d]), [(int(starts[first[d] + h["first"]]), int(ends[first[d] + h["first"] + h["n"] - 1])) for h in hits]
                    texts[d] = kept_text(data[a : offsets[d + 1]].tobytes(), [(x - a, y - a) for x, y in spans])
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, part.schema.field("text").type)], schema=pa.schema([part.schema.field("row"), part.schema.field("text")]))

    while True:
        found = stored(with_hits(rows, benchmark, window))
        if found.filter(F.size("hits") > 0).isEmpty():
            return found.select(*[F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
        rows = stored(found.select("row", "text", "hits").mapInArrow(remove, rows.schema))


def at_once(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``decontaminated`` for a benchmark of one part: each text is searched and cut in one go."""
    spark = arrow_session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(next(iter(benchmark_phrases(benchmark, window))))
    names = docs.columns

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=SHARD_BYTES):
            column = part.column("text")
            todo = np.arange(part.num_rows)
            texts = None
            while len(todo):
                now = column.take(pa.array(todo)) if texts is None else pa.array([texts[i] for i in todo], pa.string())
                data, offsets = text_buffers(now)
                low = tc.LOWER[data]
                starts, ends, first = tc.word_spans(low, offsets, tc.ALNUM)
                inside = np.zeros(len(starts) + 1, np.int64)
                begin, which = occurrences(tc.span_hash(low, starts, ends), first, shared.value)
                np.add.at(inside, begin, 1)
                np.add.at(inside, begin + shared.value.lengths[which], -1)
                inside = (np.cumsum(inside) > 0)[:-1]
                hit = np.unique(np.searchsorted(first, np.flatnonzero(inside), "right") - 1)
                if not len(hit):
                    break
                texts = texts or column.to_pylist()
                for d in hit.tolist():
                    a, own = int(offsets[d]), np.arange(first[d], first[d + 1])
                    step = np.diff(np.concatenate([[0], inside[own].astype(np.int8), [0]]))
                    heads, tails = own[np.flatnonzero(step == 1)], own[np.flatnonzero(step == -1) - 1]
                    texts[todo[d]] = kept_text(data[a : offsets[d + 1]].tobytes(), list(zip((starts[heads] - a).tolist(), (ends[tails] - a).tolist(), strict=True)))
                todo = todo[hit]
            if texts is not None:
                part = part.set_column(names.index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
            yield part

    return docs.mapInArrow(remove, docs.schema)
