"""Quality scores by attention-based multiple-instance learning over a document's passages.

A document is a bag of passages; only the bag has a label. Every passage is encoded, a gated attention
network weighs the passages, and the weighted mean of their codes is classified. All of it is trained
here, by gradient descent in numpy, from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import textcore as tc
from .runtime import arrow_session, blocks, text_buffers

#: Words of a passage.
PASSAGE = 64
#: Labelled documents that training reads at most (those whose ids hash lowest), with all their passages.
#: Scoring reads all documents.
TRAIN_DOCUMENTS = 4000
#: UTF-8 bytes of their texts together; in hash order, a document that would exceed it is left out. A passage has 64 words, and so 127 bytes at
#: least, all but the last of a text, and 2,228 bytes of features: the driver holds 600 MB of them at most, whatever the texts are.
TRAIN_BYTES = 32 << 20
#: Sizes of the passage code and of the attention space.
CODE, ATTENTION = 24, 12
EPOCHS, BAGS, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 7

#: Classes of bytes that passages are described by, each with its bytes; the rest by range below.
GROUPS = (b"\n", b" \t\r\x0b\x0c", b".", b",", b"!", b"?;:", b"|", b"#", b"*", b"$", b"%", b"&", b"<>", b"@", b"'\"`", b"-_/\\", b"()[]{}", b"=+~^")
N_CLASSES = len(GROUPS) + 5


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)  # control bytes
    out[0x80:] = 1
    for i, c in enumerate((range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)), 2):
        out[list(c)] = i
    for i, chars in enumerate(GROUPS, 5):
        out[list(chars)] = i
    return out


CLASS = byte_classes()
#: Rates of classes, rates of pairs of neighbouring classes, and five of words.
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 5


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of each text, and each text's bounds among the rows.

    A text without words is one passage, of zeros. Features are rates of byte classes and of pairs of
    them, and five numbers on words; which words they are does not enter.
    """
    starts, ends, first = tc.word_spans(data, offsets, tc.SOLID)
    words = np.diff(first)
    passages = np.maximum(1, -(-words // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(passages)])
    out = np.zeros((bounds[-1], N_FEATURES), np.float32)
    if not len(starts):
        return out, bounds
    doc = np.repeat(np.arange(len(words)), words)
    of_word = bounds[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    head = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))
    begin = starts[head]
    begin = np.where(head == first[doc[head]], offsets[doc[head]], begin)  # white space before the first word counts too
    row, own = of_word[head], doc[head]
    # A passage ends where the text's next one begins, or with the text; no byte of another text enters.
    last = np.append(own[1:] != own[:-1], True)
    stop = np.where(last, offsets[own + 1], np.append(begin[1:], 0))
    size = stop - begin
    local = np.repeat(np.arange(len(row)), size)
    at = np.arange(len(local)) - np.repeat(np.cumsum(size) - size - begin, size)
    kind, length = CLASS[data].astype(np.int32), np.maximum(size, 1)[:, None]
    one = np.bincount(local * N_CLASSES + kind[at], minlength=len(row) * N_CLASSES).reshape(len(row), -1)
    inner = at + 1 < np.repeat(offsets[own + 1], size)
    local, at = local[inner], at[inner]
    two = np.bincount(local * (N_CLASSES * N_CLASSES) + kind[at] * N_CLASSES + kind[at + 1], minlength=len(row) * N_CLASSES * N_CLASSES).reshape(len(row), -1)
    out[row, :N_CLASSES] = np.sqrt(one / length)
    out[row, N_CLASSES:-5] = np.sqrt(two / length)
    n = np.diff(np.append(head, len(starts)))
    long = (ends - starts).astype(float)
    hashes = tc.span_hash(data, starts, ends)
    order = np.lexsort((hashes, of_word))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    mean = np.add.reduceat(long, head) / n
    out[row, -5] = np.add.reduceat(fresh.astype(float), head) / n
    out[row, -4] = np.log1p(mean)
    out[row, -3] = np.sqrt(np.maximum(np.add.reduceat(long * long, head) / n - mean * mean, 0)) / 10
    out[row, -2] = np.log1p(n) / 5
    out[row, -1] = np.add.reduceat((long <= 3).astype(float), head) / n
    return out, bounds


@dataclass
class Model:
    """Encoder (w, b), gates (v, u), attention a, classifier (c, d), and the features' scale."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.parts
        code = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(code @ p["v"]), 1 / (1 + np.exp(-(code @ p["u"])))
        return code, t, g, (t * g) @ p["a"]

    def attend(self, bounds: np.ndarray, strength: np.ndarray) -> np.ndarray:
        """Softmax of the strengths within each bag."""
        bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(strength - np.maximum.reduceat(strength, bounds[:-1])[bag])
        return e / np.add.reduceat(e, bounds[:-1])[bag]

    def score(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        code, _, _, strength = self.passages((features - self.mean) / self.scale)
        z = np.add.reduceat(code * self.attend(bounds, strength)[:, None], bounds[:-1])
        return 1 / (1 + np.exp(-(z @ self.parts["c"] + self.parts["d"])))


def gradients(model: Model, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted cross-entropy of bags of scaled features, and its derivatives by every parameter."""
    p = model.parts
    bag = np.repeat(np.arange(len(labels)), np.diff(bounds))
    code, t, g, strength = model.passages(x)
    alpha = model.attend(bounds, strength)
    z = np.add.reduceat(code * alpha[:, None], bounds[:-1])
    out = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
    err = (out - labels) * weight
    dz = err[:, None] * p["c"]
    d_alpha = (code * dz[bag]).sum(1)
    d_strength = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, bounds[:-1])[bag])
    dt, dg = d_strength[:, None] * p["a"] * g * (1 - t * t), d_strength[:, None] * p["a"] * t * g * (1 - g)
    d_code = (alpha[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - code * code)
    grads = {"w": x.T @ d_code, "b": d_code.sum(0), "v": code.T @ dt, "u": code.T @ dg, "a": (t * g).T @ d_strength, "c": z.T @ err, "d": err.sum(keepdims=True)}
    with np.errstate(divide="ignore"):
        loss = -float((weight * np.where(labels == 1, np.log(out), np.log1p(-out))).sum())
    return loss, grads


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = SEED) -> Model:
    """Train on bags; each class weighs the same in all. Without both classes the score is their share."""
    rng = np.random.default_rng(seed)
    size = features.shape[1]
    mean, scale = (features.mean(0), features.std(0) + 0.02) if len(features) else (np.zeros(size), np.ones(size))
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w": draw(size, CODE), "b": np.zeros(CODE), "v": draw(CODE, ATTENTION), "u": draw(CODE, ATTENTION), "a": draw(ATTENTION), "c": draw(CODE) * 0.1, "d": np.zeros(1)}
    model = Model(mean.astype(np.float32), scale.astype(np.float32), p)
    n1 = int(labels.sum())
    if not 0 < n1 < len(labels):
        p["c"][:] = 0
        p["d"][:] = np.log((n1 + 1) / (len(labels) - n1 + 1))
        return model
    weight = np.where(labels == 1, len(labels) / (2 * n1), len(labels) / (2 * (len(labels) - n1)))
    x_all = ((features - mean) / scale).astype(np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BAGS):
            bags = order[at : at + BAGS]
            n = bounds[bags + 1] - bounds[bags]
            own = np.concatenate([[0], np.cumsum(n)])
            bag = np.repeat(np.arange(len(bags)), n)
            x = x_all[np.arange(own[-1]) - own[bag] + bounds[bags][bag]]
            _, grads = gradients(model, x, own, labels[bags], weight[bags] / len(bags))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, grad in grads.items():
                grad = grad + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``limit`` labelled documents of ``most_bytes`` together: rows of ``labels`` with a quality and crc32(doc_id) mod 3 not 1.

    A row without a document, without a doc_id or without a label is left out; a doc_id that several documents
    have counts once, with its shortest text (of equally long ones that of the least hash); no label at all gives a model that scores all texts alike.
    """
    spark = arrow_session(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("quality").cast("int").alias("quality")).filter("label_id is not null and quality in (0, 1)").filter(~held_out("label_id"))
        .groupBy("label_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    )
    order = [tuple(r) for r in chosen.collect()]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = lambda rows: F.broadcast(spark.createDataFrame(rows, "label_id bigint, quality int"))  # noqa: E731  limit rows at most
    of = lambda rows: texts.join(named(rows), F.col("doc_id") == F.col("label_id")).select("doc_id", "quality", "text")
    least = F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("mark"))).alias("r")
    found = {r["doc_id"]: r for r in of(order).groupBy("doc_id").agg(least, F.count("*").alias("n")).collect()}
    rows, held, repeated = [], 0, False
    for doc, quality in order:
        if doc in found and held + found[doc]["r"]["size"] <= most_bytes:
            held += found[doc]["r"]["size"]
            rows.append((doc, quality, found[doc]["r"]["mark"]))
            repeated |= found[doc]["n"] > 1
    own = F.broadcast(spark.createDataFrame(rows, "label_id bigint, quality int, mark bigint"))
    found = texts.join(own, (F.col("doc_id") == F.col("label_id")) & F.xxhash64("text").eqNullSafe(F.col("mark"))).select("doc_id", "quality", "text")
    if repeated:  # else texts stay where they are read, and as many tasks describe them
        found = found.dropDuplicates(["doc_id"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            features, bounds = passage_features(*text_buffers(part.column("text")))
            kept = [features[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(kept, pa.binary())], ["doc_id", "quality", "features"])

    bags = found.mapInArrow(describe, "doc_id bigint, quality int, features binary").toArrow()
    bags = bags.take(pc.sort_indices(bags, [(c, "ascending") for c in bags.column_names]))
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(bags["features"]).to_numpy() // (4 * N_FEATURES))]).astype(np.int64)
    features = np.empty((int(bounds[-1]), N_FEATURES), np.float32)
    for a, b, own in zip(bounds[:-1].tolist(), bounds[1:].tolist(), bags["features"], strict=True):
        features[a:b] = np.frombuffer(own.as_buffer(), np.float32).reshape(-1, N_FEATURES)
    return fit(features, bounds, bags["quality"].to_numpy().astype(float))


def held_out(doc_id: str):
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and quality_score, from 0 to 1, for every whole text.

    A null text counts as empty and is scored too; repeated rows get the same score, for nothing but
    the text enters; an empty table gives an empty result. A column named quality_score is replaced.
    """
    spark = arrow_session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            got = shared.value.score(*passage_features(*text_buffers(part.column("text"))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got.astype(float))], [*part.schema.names, "quality_score"])

    return docs.mapInArrow(score, schema)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with their own columns, whose score is at least ``threshold``. A quality_score of their own stays."""
    aside = "quality_score_"
    while aside in docs.columns:
        aside += "_"
    scored = score_documents(docs.withColumnRenamed("quality_score", aside), train(docs, labels)).filter(F.col("quality_score") >= threshold)
    return scored.select(*[F.col(aside).alias(c) if c == "quality_score" else c for c in docs.columns])
