"""The corpus pipeline on a small corpus: every stage against plain Python on the rows of the one before, and the whole run."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from cladeworks.llm import attention_mil, crf_pii
from cladeworks.llm.queries import VOCABULARY

from .conftest import SCHEMA, rows_of, tricky_texts, words
from .test_operators import BENCH, PII, brute_components, brute_hits, contaminated_docs, labelled_documents, near_copies

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def corpus():
    rng = random.Random(2)
    labelled, labels = labelled_documents(300)
    inside = [(i + 3000, f"{words(rng, 120)}. {t} {words(rng, 40)}.") for i, t in contaminated_docs() + PII]
    tricky = [(None if i is None else i + 5000, t) for i, t in tricky_texts()]
    return labelled + near_copies() + inside + tricky, labels


def written(spark, path, texts, labels):
    spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The folder, and the rows before the first stage and after each."""
    root = tmp_path_factory.mktemp("pipeline")
    path = written(spark, root, *corpus())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        frames.append(docs)
    return path, frames


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def by_id(rows):
    out = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(out) == sum(r["doc_id"] is not None for r in rows)
    return out


def test_documents_keep_their_columns(stages):
    _, frames = stages
    for f in frames[:-1]:
        assert f.columns == COLUMNS and f.dtypes == frames[0].dtypes
    assert all(set(r[5:]) == {"x"} for f in frames[:-1] for r in f.collect())


def test_quality(spark, stages):
    path, frames = stages
    before, after = counted(frames[0].collect()), counted(frames[1].collect())
    assert after <= before
    scored = attention_mil.score_documents(frames[0], attention_mil.train(frames[0], spark.read.parquet(f"{path}/labels.parquet"))).collect()
    assert counted((r["doc_id"], r["text"]) for r in scored if r["quality_score"] >= 0.5) == counted(k[:2] for k in after.elements())
    labels = dict(corpus()[1])
    kept = {k[0] for k in after}
    assert np.mean([(i in kept) == bool(y) for i, y in labels.items()]) > 0.95


def test_near_duplicates(stages):
    _, frames = stages
    before, after = frames[1].collect(), frames[2].collect()
    texts = [(r["doc_id"], r["text"]) for r in before]
    assert counted(after) <= counted(before)
    assert set(by_id(after)) == {i for i, n, c in brute_components(texts) if i is not None and (i == c or n == 0)}
    assert len(after) < len(before)


def test_decontamination(stages):
    _, frames = stages
    before, after = by_id(frames[2].collect()), by_id(frames[3].collect())
    assert frames[2].count() == frames[3].count() and set(before) == set(after)
    hit = {i for i, r in before.items() if brute_hits(r["text"], BENCH)[1]}
    assert len(hit) >= 4
    for i, r in after.items():
        assert brute_hits(r["text"], BENCH)[1] == 0
        assert (r["text"] != before[i]["text"]) == (i in hit) and r[2:4] == before[i][2:4]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_personal_data(stages):
    _, frames = stages
    before, after = by_id(frames[3].collect()), by_id(frames[4].collect())
    assert frames[3].count() == frames[4].count() and set(before) == set(after)
    spans = {r["doc_id"]: r["spans"] for r in crf_pii.personal_data(frames[3]).collect() if r["doc_id"] is not None}
    assert sum(bool(s) for s in spans.values()) >= 4
    for i, r in after.items():
        old = before[i]["text"]
        assert (r["text"] != old) == bool(spans[i]) and r[2:4] == before[i][2:4]
        assert all(old[s["start"] : s["stop"]] not in r["text"] for s in spans[i])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_packing_and_the_whole_run(spark, stages):
    from tokenizers import Tokenizer

    path, frames = stages
    model, want = Tokenizer.from_file(VOCABULARY), collections.Counter()
    for r in frames[4].collect():
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for p in range(-(-len(ids) // 2048)):
            own = ids[p * 2048 : (p + 1) * 2048]
            want[r["doc_id"], p, p * 2048, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    for rows in (frames[5].collect(), corpus_pipeline.run(spark, path).collect()):
        assert counted(r[:5] for r in rows) == want
        sequences = collections.defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in sequences.values():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_documents(spark, tmp_path):
    path = written(spark, tmp_path, [], [(1, 1), (2, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == COLUMNS and out.count() == 0
    assert corpus_pipeline.run(spark, path).count() == 0


def test_workers_return_memory_before_and_after_a_task(monkeypatch):
    import pyarrow as pa

    from cladeworks.llm import runtime

    said = []
    monkeypatch.setattr(runtime, "give_back", lambda: said.append("back"))
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "bc"]})
    for part in runtime.blocks(iter([batch, batch.slice(0, 0), batch]), limit=2):
        said.append(part.num_rows)
    assert said == ["back", 2, 1, 2, 1, "back"]
