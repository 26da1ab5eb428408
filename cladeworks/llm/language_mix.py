"""Which languages a text is written in, and how much of it is in each.

A language is a Markov model of bytes inside words: what follows one, two or three bytes, each order
smoothed by the one below. Its n-gram counts come from all labelled documents. A text is a mixture: every
word is in one of its languages, and expectation-maximisation finds the shares. Languages are added as
long as they raise the likelihood by more than their penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textcore as tc
from .runtime import arrow_session, blocks, text_buffers

#: Bytes of the longest n-gram.
ORDER = 4
#: Counts of the whole model, all languages together; the cells of one language follow from it. Bounds driver and broadcast.
MODEL_CELLS = 1 << 24
#: Cells of a language at most; more would not be used by four bytes inside words.
MOST_CELLS = 1 << 19
#: Weight of the lower order in each order's estimate.
SMOOTHING = 4.0
#: Log-likelihood that one word may set a language behind the best: no single word, name or code decides a text.
WORD_CAP = 12.0
#: Rounds of expectation-maximisation.
ROUNDS = 25
#: Log-likelihood a language must add, in logarithms of the text's words.
PENALTY = 2.0
UNKNOWN = "und"

#: ASCII letters in lower case and all bytes of other characters.
LETTER = tc.ALNUM & ~((np.arange(256) >= 0x30) & (np.arange(256) <= 0x39))
BEFORE, AFTER = 0x20, 0x01


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of each distinct word, and for every (text, distinct word): the text, the word's number, and how often."""
    starts, ends, first = tc.word_spans(data, offsets, LETTER)
    _, at, code = np.unique(tc.span_hash(data, starts, ends), return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair, often = np.unique(doc * max(len(at), 1) + code, return_counts=True)
    doc, word = np.divmod(pair, max(len(at), 1))
    return starts[at], ends[at], doc, word, often


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cells of all n-grams of words, by order, each word between its marks; and each word's first place.

    Place 0 of a word is the mark before it, then come its bytes and the mark after it.
    """
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size + ORDER)])
    flat = np.full(first[-1], BEFORE, np.uint64)
    inner = np.repeat(starts - first[:-1] - (ORDER - 1), size) + (body := np.arange(int(size.sum())) + np.repeat(first[:-1] + ORDER - 1 - np.concatenate([[0], np.cumsum(size)])[:-1], size))
    flat[body] = data[inner]
    flat[first[1:] - 1] = AFTER
    keep = np.ones(first[-1], bool)
    for k in range(ORDER - 2):
        keep[first[:-1] + k] = False
    out, value = [], np.zeros(first[-1], np.uint64)
    for k in range(ORDER):
        value[k:] |= flat[: len(flat) - k] << np.uint64(8 * k)
        out.append((tc.mix(value[keep] + np.uint64((k + 1) << 40)) & np.uint64(cells - 1)).astype(np.int64))
    return first[:-1] - np.arange(len(size)) * (ORDER - 2), out


def learnable(doc_id: Column) -> Column:
    """Documents that the model may learn from: four fifths, by the CRC of the id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    counts: np.ndarray  # cells x languages
    total: np.ndarray  # bytes by language
    prior: np.ndarray  # share of the documents

    @property
    def cells(self) -> int:
        return len(self.counts)

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        if not len(starts):
            return np.zeros((0, len(self.languages)))
        first, by = grams(data, starts, ends, self.cells)
        p = np.full((len(by[0]), len(self.languages)), 1 / 256)
        for k, cell in enumerate(by):
            held = self.counts[cell]
            p[1:] = (held[1:] + SMOOTHING * p[1:]) / ((self.total if k == 0 else before[:-1]) + SMOOTHING)  # noqa: F821
            before = held
        p[first] = 1
        return np.add.reduceat(np.log(p), first, axis=0)


def cells_of(languages: int) -> int:
    """Cells of a language: a power of two."""
    return min(MOST_CELLS, 1 << int(np.log2(max(MODEL_CELLS // max(languages, 1), 2))))


def train(docs: DataFrame) -> Model:
    """Counts of all n-grams of all documents that have a language, less the held-out fifth.

    Each task adds up what it reads and gives a row for each cell that has any; these are summed, and
    MODEL_CELLS rows at most reach the driver. A language that holds most documents is counted where it is read.
    """
    spark = arrow_session(docs.sparkSession)
    rows = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shares = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect())
    languages = [lang for lang, _ in shares]
    cells = cells_of(len(languages))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in blocks(batches):
            data, offsets = text_buffers(part.column("text"))
            data = tc.LOWER[data]
            starts, ends, doc, word, often = word_counts(data, offsets)
            if not len(starts):
                continue
            names = part.column("lang").to_pylist()
            kinds = sorted(set(names))
            lang = np.array([kinds.index(x) for x in names])[doc]
            first, by = grams(data, starts, ends, cells)
            word_of = np.repeat(np.arange(len(starts)), np.diff(np.append(first, len(by[0]))))
            for i, name in enumerate(kinds):
                weight = np.bincount(word[lang == i], often[lang == i], len(starts))[word_of]
                own = held.setdefault(name, np.zeros(cells + 1))
                mark = np.zeros(len(word_of), bool)
                mark[first] = True
                for k, cell in enumerate(by):
                    own[:-1] += np.bincount(cell, np.where(mark, 0, weight) if k == ORDER - 1 else weight, cells)
                own[-1] += weight[~mark].sum()
        for name, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at].astype(np.int64))], ["lang", "cell", "n"])

    sums = rows.mapInArrow(count, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((cells + 1, len(languages)))
    at = {name: i for i, name in enumerate(languages)}
    if sums.num_rows:
        coded = sums.column("lang").combine_chunks().dictionary_encode()
        lang = np.array([at[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        counts[sums.column("cell").to_numpy(), lang] = sums.column("n").to_numpy()
    n = np.array([c for _, c in shares], float)
    return Model(languages, counts[:-1].astype(np.float32), counts[-1], n / max(n.sum(), 1))


def expected(p: np.ndarray, doc: np.ndarray, often: np.ndarray, first: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each text's words in each language by expectation-maximisation from ``share``, and the log-likelihood besides the words' best ones.

    p: (text, word) rows by languages, the likelihood next to the word's best; rows are grouped by text and
    begin at ``first``. A language whose share is 0 stays out.
    """
    n = np.add.reduceat(often, first)[:, None]
    for _ in range(ROUNDS):
        mixed = p * share[doc]
        share = np.add.reduceat(mixed / mixed.sum(1, keepdims=True) * often[:, None], first, axis=0) / n
    return share, np.add.reduceat(np.log((p * share[doc]).sum(1)) * often, first)


def mixtures(scores: np.ndarray, doc: np.ndarray, often: np.ndarray, prior: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """For each text that has words: the shares of its chosen languages, and each language's probability if the text were in one.

    The first language is the likeliest one; the others join by their share among all languages, one by
    one, as long as the likelihood gains more than ``penalty`` times the logarithm of the text's words.
    """
    best = scores.max(1, keepdims=True)
    behind = np.maximum(scores - best, -WORD_CAP)
    p = np.exp(behind)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    at = np.cumsum(np.diff(doc, prepend=-1) > 0) - 1
    n = np.add.reduceat(often, first)
    single = np.add.reduceat(behind * often[:, None], first, axis=0)
    known = single + np.log(np.maximum(prior, 1e-12))
    one = np.exp(known - known.max(1, keepdims=True))
    one /= one.sum(1, keepdims=True)
    rows, langs = single.shape
    lead = known.argmax(1)
    share = np.zeros((rows, langs))
    share[np.arange(rows), lead] = 1
    value = single[np.arange(rows), lead]
    if langs == 1:
        return share, one
    every, bound = expected(p, at, often, first, np.full((rows, langs), 1 / langs))
    price = penalty * np.log(n + 1)
    every[np.arange(rows), lead] = 2
    order = np.argsort(-every, 1, kind="stable")
    live = np.flatnonzero(bound - value > price)
    for size in range(2, langs + 1):
        if not len(live):
            break
        rows_in = np.isin(at, live)
        own = at[rows_in]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        start = np.zeros((len(live), langs))
        np.put_along_axis(start, order[live, :size], 1 / size, 1)
        got, gain = expected(p[rows_in], np.cumsum(np.diff(own, prepend=-1) > 0) - 1, often[rows_in], begin, start)
        better = gain - value[live] > price[live]
        share[live[better]], value[live[better]] = got[better], gain[better]
        live = live[better]
    return share, one


def found(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the texts that have words, their shares by language, and the single-language probabilities."""
    data = tc.LOWER[data]
    starts, ends, doc, word, often = word_counts(data, offsets)
    langs = len(model.languages)
    if not len(starts) or not langs:
        return np.zeros(0, np.int64), np.zeros((0, langs)), np.zeros((0, langs))
    share, one = mixtures(model.word_scores(data, starts, ends)[word], doc, often, model.prior)
    return np.unique(doc), share, one


MIXTURE = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """MIXTURE of every document: its main language, how sure that is, and all languages of the chosen set by their shares.

    score is the main language's share; where it is the only one, its probability among all. A text
    that is null or has no letter, and any text where nothing was learned, is ``und`` with score 0 and no
    languages. A null doc_id is not held out. Repeated rows are each judged; other columns are not read.
    """
    spark = arrow_session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in blocks(batches):
            data, offsets = text_buffers(part.column("text"))
            at, share, one = found(data, offsets, m)
            main = share.argmax(1) if len(at) else at
            score = np.where((share > 0).sum(1) == 1, one[np.arange(len(at)), main], share[np.arange(len(at)), main]) if len(at) else np.zeros(0)
            lettered = part.column("lettered").to_pylist()
            names, scores, sets = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows, [[]] * part.num_rows
            for i, doc in enumerate(at.tolist()):
                if lettered[doc]:
                    names[doc], scores[doc] = m.languages[main[i]], float(min(score[i], 1.0))
                    sets[doc] = [{"lang": m.languages[k], "share": float(share[i, k])} for k in np.argsort(-share[i], kind="stable") if share[i, k] > 0]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(scores, pa.float64()), pa.array(sets, kind)], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("lettered"), text.alias("text"))
    return rows.mapInArrow(judge, MIXTURE)
