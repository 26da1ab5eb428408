"""Best-fit packing of tokenised documents under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .runtime import arrow_session, blocks, pinned, text_buffers

#: Longest sequence, in tokens.
MAX_TOKENS = 2048
#: Most pieces of documents in one sequence. A piece has a token at least, so this many always fit.
MAX_DOCS = MAX_TOKENS
#: Most attention cost of a sequence: the sum of its pieces' squared lengths. Whatever fits by tokens fits
#: by this; a smaller one makes sequences of long pieces wait for no more.
MAX_COST = 2048 * 2048
#: Weights of the residual tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 1.0, 1.0)
#: Pieces that are packed together. A fixed size keeps a task's time and memory level at any input size.
SHARD_PIECES = 8192

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


_BYTE = np.arange(256)
_LETTER = (_BYTE >= 0x61) & (_BYTE <= 0x7A) | (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_PUNCTUATION = (_BYTE > 0x20) & (_BYTE < 0x7F) & ~_LETTER & ~((_BYTE >= 0x30) & (_BYTE <= 0x39)) & (_BYTE != 0x27)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in lower case, and chunks that are tokenised alike on their own: starts, ends, first of each text.

    Chunks end at white space and between letters and punctuation. Letters are a-z and the two-byte ones
    of Latin-1. A capital before a non-ASCII byte stays: a mark there composes with small letters only.
    Not for texts with special tokens, which hold punctuation and are told by case.
    """
    starts, ends, _ = tc.word_spans(data, offsets, tc.SOLID)
    low = tc.LOWER[data]
    if len(data) > 1:
        held = np.flatnonzero(data[1:] >= 0x80)
        low[held] = data[held]
        punctuation = _PUNCTUATION[data]
        begins = _LETTER[data]
        closes = begins.copy()
        latin = np.flatnonzero(data[:-1] == 0xC3)
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        begins[latin] = True
        closes[latin + 1] = True
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = closes[:-1] & punctuation[1:] | punctuation[:-1] & begins[1:]
        cut[offsets] = False
        both = cut.copy()
        both[starts] = True
        cut[ends] = True
        starts, ends = np.flatnonzero(both), np.flatnonzero(cut)
    return low, starts, ends, np.searchsorted(starts, offsets)


class WordTokenizer:
    """Token ids of whole texts through a cache of white-space separated chunks.

    The vocabulary's normaliser and splitter never join characters across ASCII white space, nor a letter
    and ASCII punctuation other than an apostrophe, so a text's ids are those of its chunks, end to end.
    Chunks are cached by 64-bit hash; the cache is
    emptied at ``limit`` entries.
    """

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.model, self.limit = Tokenizer.from_file(path), limit
        self.reset()

    def reset(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, hashes: list[int], chunks: list[str]) -> None:
        for h, enc in zip(hashes, self.model.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            ids = enc.ids
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            row = len(self.rows)
            if row == len(self.begin):
                self.begin, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.count))
            self.flat[self.used : self.used + len(ids)] = ids
            self.begin[row], self.count[row] = self.used, len(ids)
            self.used += len(ids)
            self.rows[h] = row

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and the texts' offsets among them."""
        raw = data.tobytes()
        data, starts, ends, first = chunks(data, offsets) if b"<|" not in raw else (data, *tc.word_spans(data, offsets, tc.SOLID))
        keys, at, inverse = np.unique(tc.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.rows) + len(keys) > self.limit:
            self.reset()
        listed = keys.tolist()
        fresh = [i for i, k in enumerate(listed) if k not in self.rows]
        if fresh:
            raw = data.tobytes()  # in lower case
            self.add([listed[i] for i in fresh], [raw[starts[at[i]] : ends[at[i]]].decode("utf-8", "replace") for i in fresh])
        row = np.fromiter((self.rows[k] for k in listed), np.int64, len(listed))[inverse]
        count = self.count[row]
        closes = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.begin[row] - closes[:-1], count) + np.arange(closes[-1])]
        per_doc = closes[first[1:]] - closes[first[:-1]]
        bounds = np.concatenate([[0], np.cumsum(per_doc + 1)])
        out = np.full(bounds[-1], end_id, np.uint32)
        out[np.arange(closes[-1]) + np.repeat(np.arange(len(per_doc)), per_doc)] = ids
        return out, bounds


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (then ``end_id``) into pieces of at most ``max_tokens``.

    One row for each piece: doc_id, piece, start, length, ids_crc32 and, if ``with_ids``, the ids.
    Null and empty texts give one piece that holds only ``end_id``; repeated rows are packed each;
    a null doc_id stays null. Columns besides doc_id and text are not read.
    """
    arrow_session(docs.sparkSession)
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int64()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(vocabulary)
        for part in blocks(batches):
            ids, bounds = model.encode(*text_buffers(part.column("text")), end_id)
            ids = ids.astype("<u4")
            size = np.diff(bounds)
            n = -(-size // max_tokens)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * max_tokens
            length = np.minimum(max_tokens, size[doc] - start)
            lo = bounds[doc] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            arrays = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(lo - lo[0], lo[-1] + length[-1] - lo[0]).astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES + ", ids array<bigint>" * with_ids)


def vector_best_fit(lengths: np.ndarray, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS, max_cost: float = MAX_COST, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of pieces, largest first.

    A piece asks for (length, 1, length squared). Among the open bins that hold all three, ``norm``
    takes the one whose weighted residual after the piece is least, ``dot`` the one whose residual
    has the greatest weighted product with the piece's demand. Without one, a bin opens; a piece
    whose own cost is above the capacity has a bin to itself.
    """
    cap = np.array([max_tokens, max_docs, max_cost], float)
    w = np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((3, max(1, len(lengths))))
    name = np.zeros(max(1, len(lengths)), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    opened = live = 0
    for i in order.tolist():
        n = int(lengths[i])
        need = np.array([n, 1, float(n) * n]) / cap
        at = -1
        if live:
            fits = (left[:, :live] >= need[:, None] - 1e-12).all(axis=0)
            if fits.any():
                rest = left[:, :live]
                score = -(w @ (rest - need[:, None]) ** 2) if rule == "norm" else (w * need) @ rest
                at = int(np.argmax(np.where(fits, score, -np.inf)))
        if at < 0:
            at, live = live, live + 1
            left[:, at], name[at] = 1.0, opened
            opened += 1
        bins[i] = name[at]
        offset[i] = round((1.0 - left[0, at]) * max_tokens)
        left[:, at] -= need
        if left[0, at] * max_tokens < least - 1e-6 or (left[1:, at] <= 0).any():  # no later piece fits
            live -= 1
            left[:, at], name[at] = left[:, live], name[live]
    return bins, offset


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS, max_cost: float = MAX_COST, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give every piece of ``token_pieces`` a sequence and its place there (gapless from 0).

    Pieces are dealt by a hash of all they are to shards of about ``shard_pieces`` and packed within
    them, so copies of one document spread and no task grows with the input. An empty input gives
    an empty result.
    """
    kept = pinned(pieces)
    total = kept.count()
    shards = max(1, -(-total // shard_pieces))
    columns = kept.columns

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offset = vector_best_fit(group["length"].to_numpy(), max_tokens, max_docs, max_cost, weights, rule)
        return group[columns].assign(sequence_id=group["shard_no"].to_numpy() * (1 << 32) + bins, offset=offset)

    # Rows that are equal in all columns would share a hash: their partition and place there tell them apart.
    salted = kept.withColumn("shard_no", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    return salted.groupBy("shard_no").applyInPandas(fit, ", ".join(f"{n} {t}" for n, t in [*kept.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")]))


def packed_ids(pieces_with_ids: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and the ids of its pieces in order of offset."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
