"""The filter audit, the language mixtures and the Merkle manifest against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.llm import filter_audit, language_mix, merkle, queries
from cladeworks.llm.runtime import text_buffers

from .conftest import SCHEMA, rows_of, tricky_texts

LABELS = "doc_id bigint, quality int, toxic int, text string"


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, low=False):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if v is not None:
            v = str(v)
            if low and c == "text":
                v = re.sub("[A-Z]", lambda m: m[0].lower(), v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return H(out)


def plain_tree(nodes):
    """The root, and for each node the runs that it and its parents stand in, with their places."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 8 * 8
            p.append((nodes[run : run + 8], at[i] - run))
            at[i] //= 8
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        trees[lang] = plain_tree([x[2] for x in by[lang]])
    root, tops = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        subroot, paths = trees[lang]
        for (_, _, leaf, r), path in zip(by[lang], paths, strict=True):
            chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now, proof = plain_leaf(r, True) if chosen else leaf, ""
            for run, k in path + top:
                proof += "".join(run[:k] + run[k + 1 :])
                now = H(*run[:k], now, *run[k + 1 :])
            out.append((str(r["doc_id"]), leaf, subroot, root, H(proof), now, now == root))
    return sorted(out)


def of_manifest(df):
    return sorted((str(r["doc_id"]), *r[1:]) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_of_tricky_rows(spark, tricky):
    more = spark.createDataFrame(rows_of([(100 + i, f"Text {i}") for i in range(30)]), SCHEMA).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 21))
    docs = tricky.withColumn("lang", F.when(F.col("doc_id") % 4 == 1, None).when(F.col("doc_id") == 24, "").otherwise(F.col("lang"))).unionByName(more)
    assert of_manifest(merkle.manifest(docs)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_beyond_a_block(spark):
    """A tree of three blocks, one of exactly one block, one of one leaf."""
    docs = spark.range(merkle.BLOCK * 3 + 700).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") == 5, "one").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("lang"), F.lit(3).cast("bigint").alias("n_chars"), F.concat(F.lit("T"), F.col("id")).alias("text"))
    assert of_manifest(merkle.manifest(docs)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_proofs_are_the_siblings(spark, tricky):
    rows = merkle.with_proofs(merkle.leaves(tricky), siblings=True).collect()
    for r in rows:
        assert hashlib.sha256(r["proof"].encode()).hexdigest() == r["proof_sha256"] and len(r["proof"]) % 64 == 0


def test_manifest_of_one_row_and_of_none(spark, nothing):
    one = spark.createDataFrame(rows_of([(None, None)]), SCHEMA)
    (r,) = merkle.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == H("")
    assert merkle.manifest(nothing).collect() == []


# Filter audit


def plain_audit(docs, labels):
    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    said = defaultdict(lambda: [False, False])
    for x in labels:
        said[x["doc_id"]][0] |= x["quality"] == 1
        said[x["doc_id"]][1] |= x["toxic"] == 1
    by = defaultdict(list)
    for d in docs:
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d["doc_id"] is not None and least[t] < d["doc_id"]}
        by[d["source"] or ""].append((fails, said[d["doc_id"]] if d["doc_id"] in said else [False, False]))
    out = []
    for part, own in by.items():
        rows, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                gone = lambda x: any(x[0][g] for g in order[:step])  # noqa: E731, B023
                here = [x for x in own if x[0][f] and not gone(x)]
                shapley[f] += len(here)
                rows.append([part, order, step + 1, sum(not gone(x) and not x[0][f] for x in own), len(here), sum(x[0][f] and gone(x) for x in own), sum(x[0][f] and sum(x[0].values()) == 1 for x in own), sum(x[1][0] for x in here), sum(x[1][1] for x in here)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select(*[c.split()[0] for c in filter_audit.AUDIT.split(", ")]).collect())


@pytest.fixture(scope="module")
def audit_docs(spark, tricky):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randint(0, 900)}" for _ in range(4000))
    texts = [(50, long), (51, long), (52, long[:-1] + "#"), (53, "x" + long[1:]), (60, "same"), (40, "same"), (61, "SAME"), (62, "emas"), (63, "ABCD" * 100), (64, "ABCD" * 100), (65, " ".join(f"word{i}" for i in range(300))), (66, None), (67, " ".join(f"word{i}" for i in range(300)))]
    return tricky.unionByName(spark.createDataFrame(rows_of(texts), SCHEMA)).withColumn("source", F.when(F.col("doc_id") == 61, "").otherwise(F.col("source")))


@pytest.fixture(scope="module")
def audit_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2, "x") for i in [*range(70), 5, 51]] + [(5, 1, None, None), (None, 1, 1, "")], LABELS)


def test_audit_equals_every_order_by_hand(audit_docs, audit_labels):
    want = plain_audit([r.asDict() for r in audit_docs.collect()], [r.asDict() for r in audit_labels.collect() if r["doc_id"] is not None])
    assert audit_rows(filter_audit.interactions(audit_docs, audit_labels)) == want
    # A filter's shares add up to what all filters together remove, 120 times over.
    by = defaultdict(set)
    for part, order, step, *_, shapley in want:
        by[part].add((order[step - 1], shapley))
    gone = {p: sum(r[4] for r in want if r[0] == p and r[1] == "ABCDE") for p in by}
    assert all(sum(s for _, s in by[p]) == 120 * gone[p] for p in by)


def test_texts_decide_where_hashes_agree(audit_docs, audit_labels):
    """A hash that tells no blocks apart: all texts of one length are one class, and the texts themselves decide."""
    blind = filter_audit.masks(audit_docs, lambda c: F.lit(7).cast("bigint"))
    exact = filter_audit.masks(audit_docs)
    assert sorted(map(str, blind.collect())) == sorted(map(str, exact.collect()))


def test_refinement_keeps_no_singletons(spark):
    rows = spark.createDataFrame([(1, 300, [1, 2]), (2, 300, [1, 2]), (3, 300, [1, 3]), (4, 300, [9, 3]), (5, 10, [4]), (6, 10, [4]), (7, 11, [4]), (8, 0, []), (None, 0, [])], "doc_id bigint, length bigint, blocks array<bigint>")
    assert sorted((r["length"], r["least"]) for r in filter_audit.refined(rows, 300).collect()) == [(0, 8), (10, 5), (300, 1)]


def test_audit_of_nothing(spark, nothing, audit_labels):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.interactions(nothing, audit_labels).collect() == []
    one = spark.createDataFrame(rows_of([(1, None)]), SCHEMA)
    assert audit_rows(filter_audit.interactions(one, none)) == plain_audit([r.asDict() for r in one.collect()], [])


# Language mixtures


def language_texts(rng, kind, n):
    parts = {"a": ("ka", "lo", "mi", "tra", "ost"), "b": ("über", "schn", "ück", "tz", "pf"), "c": ("ción", "ñe", "llo", "ará", "que")}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = [(i, language_texts(rng, "abc"[i % 3], rng.randint(3, 60)), "abc"[i % 3]) for i in range(300)]
    rows += [(1000 + i, language_texts(rng, "a", 60) + ". " + language_texts(rng, "b", 30), None) for i in range(20)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "12 34 -- !", "b"), (None, "kalo milo", "a"), (2003, "漢字", None), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"held_out": F.lit("x"), "lettered": F.lit("y"), "score": F.lit("z"), "languages": F.lit(1)})


def plain_scores(model_docs, word):
    """Log-likelihood of a word under each language, from counts of strings of bytes."""
    out = {}
    for lang, texts in model_docs.items():
        n = Counter()
        total = 0
        for t in texts:
            for w in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())):
                s = b"   " + w + b"\x01"
                for i in range(2, len(s)):
                    for k in range(1, 5):
                        if k < 4 or i > 2:
                            n[s[i - k + 1 : i + 1]] += 1
                total += len(w) + 1
        s, score = b"   " + word + b"\x01", 0.0
        for i in range(3, len(s)):
            p = 1 / 256
            for k in range(1, 5):
                context = total if k == 1 else n[s[i - k + 1 : i]]
                p = (n[s[i - k + 1 : i + 1]] + 4.0 * p) / (context + 4.0)
            score += math.log(p)
        out[lang] = score
    return out


def test_word_scores_equal_a_plain_model(spark, spoken):
    import pyarrow as pa

    docs = spoken.filter("doc_id < 40")
    model = language_mix.train(docs)
    texts = defaultdict(list)
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None:
            texts[r["lang"]].append(r["text"])
    words = [b"kalo", "überück".encode(), b"x", "ñellos".encode()]
    data, offsets = text_buffers(pa.array([w.decode() for w in words]))
    got = model.word_scores(data, offsets[:-1], offsets[1:])
    for row, w in zip(got, words, strict=True):
        want = plain_scores(texts, w)
        assert row == pytest.approx([want[x] for x in model.languages], rel=1e-5)


def test_shares_equal_plain_expectation_maximisation():
    rng = np.random.default_rng(2)
    scores = rng.normal(0, 6, (50, 3))
    doc, often = np.sort(rng.integers(0, 4, 50)), rng.integers(1, 4, 50)
    share, one = language_mix.mixtures(scores, doc, often, np.ones(3) / 3, penalty=0.5)
    for d in np.unique(doc):
        own, n = scores[doc == d], often[doc == d]
        p = np.exp(np.maximum(own - own.max(1, keepdims=True), -language_mix.WORD_CAP))

        def fit(langs):
            pi = np.array([1 / len(langs) if k in langs else 0 for k in range(3)])
            for _ in range(language_mix.ROUNDS):
                r = p * pi
                pi = (r / r.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            return pi, (np.log((p * pi).sum(1)) * n).sum()

        lead = int(np.argmax((np.log(p) * n[:, None]).sum(0)))
        order = [lead, *[k for k in np.argsort(-fit((0, 1, 2))[0], kind="stable") if k != lead]]
        best, value = fit((lead,))
        for size in (2, 3):
            got, gain = fit(order[:size])
            if gain - value <= 0.5 * math.log(n.sum() + 1):
                break
            best, value = got, gain
        assert share[list(np.unique(doc)).index(d)] == pytest.approx(best)
    assert one.sum(1) == pytest.approx(1)


def test_languages_of_held_out_and_mixed_texts(spoken):
    rows = language_mix.identify(spoken, language_mix.train(spoken)).collect()
    given = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    assert len(rows) == spoken.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (2000, 2001, 2002):
            assert (r["lang_pred"], r["score"], r["languages"]) == ("und", 0.0, [])
        elif r["doc_id"] is not None and r["doc_id"] < 1000:
            assert r["lang_pred"] == given[r["doc_id"]] and len(r["languages"]) == 1
        elif r["doc_id"] is not None and r["doc_id"] < 2000:
            assert [x["lang"] for x in r["languages"]] == ["a", "b"] and r["languages"][0]["share"] == pytest.approx(2 / 3, abs=0.05)


def test_nothing_learned(spark, spoken, nothing):
    silent = spoken.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_mix.identify(spoken, language_mix.train(silent)).collect()} == {"und"}
    assert language_mix.identify(nothing, language_mix.train(nothing)).collect() == []
    assert language_mix.cells_of(4) == language_mix.MOST_CELLS and language_mix.cells_of(100_000) * 100_000 <= language_mix.MODEL_CELLS


def test_labels_are_no_inputs_of_a_prediction(spoken):
    model = language_mix.train(spoken)
    other = spoken.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 1)
    a = {r["doc_id"]: r["lang_pred"] for r in language_mix.identify(spoken, model).collect() if r["doc_id"] is not None}
    b = {r["doc_id"] - 1: r["lang_pred"] for r in language_mix.identify(other, model).collect() if r["doc_id"] is not None}
    assert a == b


# Through the registered queries


def test_queries_over_tables_with_more_columns(spark, tmp_path, audit_docs, audit_labels):
    audit_docs.write.parquet(str(tmp_path / "documents.parquet"))
    audit_labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = [r.asDict() for r in audit_docs.collect()]
    assert of_manifest(queries.op13_merkle_manifest(spark, str(tmp_path))) == plain_manifest(docs)
    want = plain_audit(docs, [r.asDict() for r in audit_labels.collect() if r["doc_id"] is not None])
    assert audit_rows(queries.op11_filter_audit(spark, str(tmp_path))) == want
    rows = queries.op12_language_mixture(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and rows[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score", "languages"}
    assert {r["lang_pred"] for r in rows} <= {"en", "und"}
