"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

The field is trained from a small labelled table (``labelled_table`` or the caller's own) by maximum
likelihood in numpy, and decoded by Viterbi for many sentences at once. Patterns find what has a fixed
form; the field adds what is told by shape and neighbours: secrets after a cue, numbers grouped like
cards and phones that the patterns leave out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .runtime import arrow_session, blocks, text_buffers

KINDS = ("email", "ip", "card", "phone", "secret")
#: Labels of the field: outside, then each kind; what spans several words has a first and further ones.
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+", "secret")
N_LABELS = len(LABELS)
PLACEHOLDER = {k: f"<{k.upper()}>" for k in KINDS}

#: What may stand before an address's sign, and what follows it.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def byte_sized(part: str) -> bool:
    """Whether a run of digits, however long, is 255 at most."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the signs outwards: no run is read twice."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of 255 at most: each four parts of a dotted run."""
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            stop = at + sum(map(len, four)) + 3
            if all(map(byte_sized, four)):
                yield at, stop
            at = stop + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str, has_digit: bool = True) -> list[tuple[str, int, int]]:
    """Matches of the four patterns, by kind and then start, in code points."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if not has_digit:
        return out
    out += [("ip", a, b) for a, b in addresses(text)] if "." in text else []
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


# Word shapes


def shape_classes() -> np.ndarray:
    out = np.full(256, 15, np.uint8)
    out[0x80:] = 3
    for i, chars in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A))):
        out[list(chars)] = i
    for i, chars in enumerate((b".", b"@", b"-", b"+", b"(", b")", b"=", b"\"'`", b",;", b":", b"/"), 4):
        out[list(chars)] = i
    return out


SHAPE = shape_classes()
RUNS = 8
_RUN_WEIGHT = 17 ** np.arange(RUNS + 1, dtype=np.int64)
_RUN_WEIGHT[RUNS] = 0
#: Values of the features besides the shape and the cue: length, digits, changes between letter and digit.
SIZES = (24, 24, 8)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its collapsed shape (runs of one class count once, the first eight runs), a hash of it in lower case, and two packed counts."""
    kind = SHAPE[data]
    digit = kind == 2
    alnum = kind <= 3
    head = np.ones(len(data), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[starts] = True
    word = np.zeros(len(data) + 1, np.int32)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    within = np.cumsum(inside[:-1]) > 0
    at = np.flatnonzero(head & within)
    word = np.searchsorted(starts, at, "right") - 1
    first = np.searchsorted(at, starts)
    turn = np.minimum(np.arange(len(at)) - first[word], RUNS)
    shape = np.add.reduceat((kind[at].astype(np.int64) + 1) * _RUN_WEIGHT[turn], first)
    digits = np.add.reduceat(digit.astype(np.int32), starts)
    change = np.zeros(len(data), bool)
    change[1:] = (digit[1:] != digit[:-1]) & alnum[1:] & alnum[:-1]
    changes = np.add.reduceat(change.astype(np.int32), starts)
    counts = (np.minimum(ends - starts, SIZES[0] - 1) * SIZES[1] + np.minimum(digits, SIZES[1] - 1)) * SIZES[2] + np.minimum(changes, SIZES[2] - 1)
    return shape, tc.span_hash(tc.LOWER[data], starts, ends), counts.astype(np.int64), digits


def sentences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a sentence. One ends with its text, its line, or at a full stop, however long it is."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.zeros(len(starts), bool)
    new[first[:-1][first[:-1] < first[1:]]] = True
    line = np.searchsorted(starts, np.flatnonzero(data == 0x0A))
    new[line[line < len(starts)]] = True
    last = data[ends - 1]
    stop = ((last == 0x2E) | (last == 0x21) | (last == 0x3F)) & (digits == 0)
    new[1:] |= stop[:-1]
    head = np.flatnonzero(new)
    return head


# The field


@dataclass
class Field:
    shapes: np.ndarray  # sorted known shapes; value 0 stands for all others
    cues: np.ndarray  # sorted hashes of known words; likewise
    tables: list[list[np.ndarray]]  # weights by offset (-1, 0, 1) and feature: values x labels
    step: np.ndarray  # from label x to label
    start: np.ndarray

    def values(self, shape: np.ndarray, cue: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All features of a word as one number; equal numbers have equal weights."""
        return (self.known(self.shapes, shape) * (len(self.cues) + 1) + self.known(self.cues, cue)) * int(np.prod(SIZES)) + counts

    @staticmethod
    def known(table: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table, value), len(table) - 1)
        return np.where(table[at] == value, at + 1, 0).astype(np.int64)

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        values, counts = np.divmod(values, int(np.prod(SIZES)))
        shape, cue = np.divmod(values, len(self.cues) + 1)
        rest, changes = np.divmod(counts, SIZES[2])
        long, digits = np.divmod(rest, SIZES[1])
        return [shape, cue, long, digits, changes]

    def emissions(self, values: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Scores of all labels for each word, from its own features and its neighbours' in the sentence."""
        code, kinds = pd.factorize(values)
        parts = self.split(kinds)
        by = [sum(t[p] for t, p in zip(tables, parts, strict=True)) for tables in self.tables]
        out = by[1][code]
        edge = np.zeros(len(values), bool)
        edge[head] = True
        prev, following = by[0][code[:-1]], by[2][code[1:]]
        prev[edge[1:]] = 0
        following[edge[1:]] = 0
        out[1:] += prev
        out[:-1] += following
        return out

    def decode(self, emission: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Viterbi: the best label sequence of every sentence, all sentences step by step together."""
        n = len(emission)
        size = np.diff(np.append(head, n))
        order = np.argsort(-size, kind="stable")
        begin, size = head[order], size[order]
        back = np.zeros((n, N_LABELS), np.int8)
        best = np.zeros((len(begin), N_LABELS), np.float32)
        step, live = self.step.astype(np.float32), len(begin)
        best[:] = emission[begin] + self.start
        most = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, most + 1), "right")  # sentences of at least so many words
        for t in range(1, most):
            live = int(alive[t])
            at = begin[:live] + t
            route = best[:live, :, None] + step
            via = route.argmax(1)
            back[at] = via
            best[:live] = np.take_along_axis(route, via[:, None, :], 1)[:, 0] + emission[at]
        label = np.zeros(n, np.int8)
        now = best.argmax(1)
        label[begin + size - 1] = now
        for t in range(most - 1, 0, -1):
            live = int(alive[t])
            at = begin[:live] + t
            label[at - 1] = back[at, label[at]]
        return label


def filler(rng: random.Random) -> str:
    """One ordinary word, in the forms that running text and page debris have."""
    word = "".join(rng.choice(("an", "er", "th", "on", "re", "st", "la", "ou", "ch", "ti", "é", "ü", "ñ", "de", "qui", "ge")) for _ in range(rng.choice((1, 1, 2, 2, 3, 3, 4, 5, 7, 9))))
    draw = rng.random()
    if draw < 0.55:
        return word
    if draw < 0.62:
        return word.capitalize()
    if draw < 0.67:
        return word.upper() + rng.choice(("", "!!", "!"))
    if draw < 0.76:
        return word + rng.choice((",", ",", ";", ":"))
    if draw < 0.81:
        return word + rng.choice(("***", "%%%", "$$$", "###", "&&&"))
    if draw < 0.84:
        return rng.choice(("|", "-", "&", "/", "*", "=", "·"))
    if draw < 0.91:  # numbers that are nobody's
        n = rng.randint
        return rng.choice((str(n(1, 9)), str(n(10, 999)), str(n(1900, 2030)), f"{n(1, 9)}.{n(0, 9)}", f"{n(1, 9)}.{n(0, 9)}.{n(0, 20)}", f"{n(10, 99)}%", f"${n(1, 999)}.{n(10, 99)}", f"{n(2000, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(10, 23)}:{n(10, 59)}", f"{n(1, 9)},{n(100, 999)}", f"({n(1900, 2030)})", f"978-{n(1, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"v{n(1, 9)}.{n(0, 9)}", f"{n(10000, 9999999)}", f"No.{n(1, 99)}"))
    if draw < 0.94:
        return f"({word})"
    if draw < 0.96:
        return f'"{word}"'
    if draw < 0.98:
        return f"www.{word}.org/{word}"
    return word + rng.choice(("'s", "-" + word, "/" + word))


def personal(rng: random.Random) -> list[tuple[str, str]]:
    """(word, label) pairs of one piece of personal data, with the words that lead to it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda n, alphabet="0123456789abcdef": "".join(rng.choice(alphabet) for _ in range(n))
    name = lambda: mixed(rng.randint(3, 8), "abcdefghijklmnoprstu")
    end = rng.choice(("", "", "", ",", "%%%", "***"))
    kind = rng.choice(("email", "ip", "card", "card", "group", "phone", "phone", "plain", "secret", "secret", "assigned"))
    if kind == "email":
        return [(f"{name()}.{digits(2)}@{name()}.{name()}.com{end}", "email")]
    if kind == "ip":
        return [(".".join(str(rng.randint(0, 255)) for _ in range(4)) + end, "ip")]
    if kind == "card":
        return [(digits(16) + end, "card")]
    if kind == "group":
        return [(digits(4), "card"), (digits(4), "card+"), (digits(4), "card+"), (digits(4) + end, "card+")]
    if kind == "phone":
        return [(f"+{rng.randint(1, 99)}", "phone"), (f"({digits(3)})", "phone+"), (f"{digits(3)}-{digits(4)}{end}", "phone+")]
    if kind == "plain":
        return [(f"({digits(3)})", "phone"), (f"{digits(3)}-{digits(4)}{end}", "phone+")]
    cue = rng.choice(("token", "api_key", "apikey", "secret", "password", "passwd", "key", "auth_token", "access_key"))
    value = rng.choice((mixed(40), mixed(32), mixed(24, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    if kind == "secret":
        return [(cue, "O"), (rng.choice(("=", "=", ":")), "O"), (rng.choice((f'"{value}"', f'"{value}"', f"'{value}'", value)) + end, "secret")]
    return [(f"{cue}{rng.choice('=:')}{value}{end}", "secret")]


def labelled_table(rows: int = 1000, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label): two in three hold one or two pieces of personal data."""
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        own: list[tuple[str, str]] = []
        for _ in range(rng.choice((0, 1, 1, 2))):
            own += [(filler(rng), "O") for _ in range(rng.randint(0, 8))]
            own += personal(rng)
        own += [(filler(rng), "O") for _ in range(rng.randint(1, 8))]
        out.append(own)
    return out


def train(table: list[list[tuple[str, str]]], rounds: int = 100, rate: float = 0.2, decay: float = 2e-5) -> Field:
    """Maximum likelihood by full-batch Adam, with forward-backward sums over all sentences at once."""
    words = [w for s in table for w, _ in s]
    gold = np.array([LABELS.index(y) for s in table for _, y in s])
    data, offsets = text_buffers(pa.array([" ".join(w for w, _ in s) for s in table]))
    starts, ends, first = tc.word_spans(data, offsets, tc.SOLID)
    if len(starts) != len(words):
        raise ValueError("a labelled word holds white space or is empty")
    shape, cue, counts, _ = word_features(data, starts, ends)
    hashes, often = np.unique(cue[np.array([w.strip("=:").isalpha() or "_" in w or w in "=:" for w in words]) & (gold == 0)], return_counts=True)
    field = Field(np.unique(shape), hashes[often >= 15], [], np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS))
    values = field.values(shape, cue, counts)
    feats = field.split(values)
    sizes = [len(field.shapes) + 1, len(field.cues) + 1, *SIZES]
    field.tables = [[np.zeros((s, N_LABELS)) for s in sizes] for _ in range(3)]
    head = first[:-1]
    size = np.diff(first)
    most = int(size.max())
    live = np.arange(most) < size[:, None]
    at = np.where(live, head[:, None] + np.arange(most), 0)
    params = [field.start, field.step] + [t for tables in field.tables for t in tables]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    edge = np.zeros(len(values), bool)
    edge[head] = True
    inner = ~edge[1:]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for turn in range(1, rounds + 1):
        e = field.emissions(values, head)[at]
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + field.start
        for t in range(1, most):
            nxt = lse(alpha[:, t - 1, :, None] + field.step, 1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        beta = np.zeros_like(e)
        d_step = np.zeros_like(field.step)
        total = lse(alpha[:, -1], 1)
        for t in range(most - 1, 0, -1):
            ahead = field.step + (e[:, t] + beta[:, t])[:, None, :]
            both = np.exp(alpha[:, t - 1, :, None] + ahead - total[:, None, None]) * live[:, t, None, None]
            d_step -= both.sum(0)
            beta[:, t - 1] = np.where(live[:, t, None], lse(ahead, 2), 0)
        share = np.exp(alpha + beta - total[:, None, None])[live]
        share[np.arange(len(gold)), gold] -= 1
        np.add.at(d_step, (gold[:-1][inner], gold[1:][inner]), 1)
        grads = [-share[head].sum(0), d_step]
        for o in (-1, 0, 1):
            for f, s in zip(feats, sizes, strict=True):
                g = np.zeros((s, N_LABELS))
                if o == 0:
                    np.add.at(g, f, -share)
                elif o < 0:
                    np.add.at(g, f[:-1][inner], -share[1:][inner])
                else:
                    np.add.at(g, f[1:][inner], -share[:-1][inner])
                grads.append(g)
        for k, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g / len(table) - decay * p
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p += rate * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.99**turn)) + 1e-8)
    field.tables = [[t.astype(np.float32) for t in tables] for tables in field.tables]
    field.start = field.start.astype(np.float32)
    return field


_trained: list[Field] = []


def default_field() -> Field:
    """The field of the built-in table, trained once a driver process."""
    if not _trained:
        _trained.append(train(labelled_table()))
    return _trained[0]


_EDGE = b" \t\r\n\"'`,;:!?.*%$#&|<>"


def field_spans(data: np.ndarray, offsets: np.ndarray, field: Field) -> dict[int, list[tuple[str, int, int]]]:
    """By text: (kind, start, end) of what the field finds, in bytes from the text's start."""
    starts, ends, first = tc.word_spans(data, offsets, tc.SOLID)
    if not len(starts):
        return {}
    shape, cue, counts, digits = word_features(data, starts, ends)
    head = sentences(data, starts, ends, first, digits)
    label = field.decode(field.emissions(field.values(shape, cue, counts), head), head)
    found: dict[int, list[tuple[str, int, int]]] = {}
    begins = set(head.tolist())
    last: tuple[int, str, int] | None = None
    for w in np.flatnonzero(label).tolist():
        name = LABELS[label[w]]
        kind, further = name.rstrip("+"), name.endswith("+")
        doc = int(np.searchsorted(first, w, "right")) - 1
        a, b = int(starts[w]), int(ends[w])
        raw = data[a:b].tobytes()
        if further and last == (doc, kind, w - 1) and w not in begins:
            k, s, _ = found[doc][-1]
            found[doc][-1] = (k, s, b - len(raw) + len(raw.rstrip(_EDGE)) - int(offsets[doc]))
        else:
            if kind == "secret" and (cut := max(raw.find(b"="), raw.find(b":"))) >= 0:
                a, raw = a + cut + 1, raw[cut + 1 :]
            a += len(raw) - len(raw.lstrip(_EDGE))
            b -= len(raw) - len(raw.rstrip(_EDGE))
            if b <= a:
                continue
            found.setdefault(doc, []).append((kind, a - int(offsets[doc]), b - int(offsets[doc])))
        last = (doc, kind, w)
    return found


def spans_of(part: pa.RecordBatch, field: Field) -> Iterator[tuple[str, list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text: itself, its base spans, and all spans, by kind and then start."""
    column = part.column("text")
    data, offsets = text_buffers(column)
    digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])[offsets]
    more = field_spans(data, offsets, field)
    for i, text in enumerate(column.to_pylist()):
        text = text or ""
        base = base_spans(text, digits[i + 1] > digits[i])
        if i not in more:
            yield text, base, base
            continue
        # Code points before each byte, and base spans' code points before each code point: one pass, however many spans.
        points = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
        edge = np.zeros(len(text) + 1, np.int64)
        for _, x, y in base:
            edge[x] += 1
            edge[y] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        own = [(k, int(points[a]), int(points[b])) for k, a, b in more[i]]
        own = [(k, a, b) for k, a, b in own if plausible(k, text[a:b]) and covered[a] == covered[b]]
        yield text, base, sorted(base + own, key=lambda s: (KINDS.index(s[0]), s[1]))


def plausible(kind: str, span: str) -> bool:
    """What a shape cannot tell: an address has its sign, four parts are at most 255, card numbers have 13 to 19 digits that pass Luhn, phones 7 to 15, a secret mixes digits with other characters."""
    digits = "".join(_DIGITS.findall(span))
    if kind == "email":
        return "@" in span
    if kind == "ip":
        return len(parts := _DIGITS.findall(span)) == 4 and all(map(byte_sized, parts))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return len(span) >= 8 and digits != "" and digits != span


SPANS = "doc_id bigint, spans array<struct<kind:string,start:bigint,stop:bigint>>, n_base array<bigint>, base array<string>"


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, spans (kind, start, stop in code points), n_base (base spans of the first four kinds) and base (as kind:start:end).

    A null or empty text has no spans; repeated rows are each searched; an empty table gives an
    empty result; columns besides doc_id and text are not read.
    """
    spark = arrow_session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field or default_field())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            spans, counts, base = [], [], []
            for _, own, every in spans_of(part, shared.value):
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in every])
                counts.append([sum(k == name for k, _, _ in own) for name in KINDS[:4]])
                base.append([f"{k}:{a}:{b}" for k, a, b in own])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.list_(pa.string()))], ["doc_id", "spans", "n_base", "base"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, SPANS)


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All documents with placeholders for every span (overlapping ones become one); n_chars, where there is one, is counted anew in changed texts.

    Null and empty texts, and all columns besides these two, stay as they are; repeated rows are each searched;
    an empty table gives an empty result.
    """
    spark = arrow_session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field or default_field())
    names = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            texts = part.column("text").to_pylist()
            lengths = part.column("n_chars").to_pylist() if "n_chars" in names else []
            changed = False
            for i, (text, _, spans) in enumerate(spans_of(part, shared.value)):
                if not spans:
                    continue
                out, at = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        out += [text[at:a], PLACEHOLDER[kind]]
                    at = max(at, b)
                texts[i] = "".join(out) + text[at:]
                changed = True
                if lengths:
                    lengths[i] = len(texts[i])
            if changed:
                part = part.set_column(names.index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
                if lengths:
                    part = part.set_column(names.index("n_chars"), part.schema.field("n_chars"), pa.array(lengths, part.schema.field("n_chars").type))
            yield part

    return docs.mapInArrow(redact, docs.schema)
