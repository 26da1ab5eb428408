"""Each operator on tricky rows against brute force, and on an empty table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.llm import adaptive_rules, attention_mil, crf_pii, fm_index, hilbert, jaccard_join, license_index, packing, suffix_dedup, warc
from cladeworks.llm.queries import VOCABULARY

from .conftest import rows_of, tricky_texts, SCHEMA

TEXTS = tricky_texts()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SOLID, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


# WARC


def test_warc_links_and_digests(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>A &amp; B</p><script>x</script><!-- c -->tail"), (2, None, None), (None, "http://b", ""), (1, "http://a", "<p>A &amp; B</p><script>x</script><!-- c -->tail")], "page_id bigint, url string, html string")
    source = warc.responses(pages).collect()
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 2 * len(source)
    by_id = {r["record_id"]: r for r in source}
    for r in rows:
        s = by_id[r["refers_to"]]
        assert r["source_payload_digest"] == "sha256:" + hashlib.sha256(s["payload"].encode()).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
    texts = {r["block"] for r in rows if r["warc_type"] == "conversion" and r["page_id"] == 1}
    assert texts == {"A & B\n tail"} or texts == {"A & B\ntail"}
    conversions = {r["warc_record_id"]: r for r in rows if r["warc_type"] == "conversion"}
    for r in rows:
        if r["warc_type"] == "metadata":
            assert re.search(r"conversion-record-id: (\S+)", r["block"])[1] in conversions


def test_all_references_are_resolved(spark):
    import html

    names = " ".join(f"&{n}" for n in html.entities.html5 if not n.startswith("nbsp") and n.lower() not in {"nonbreakingspace;"})
    texts = [
        names, "&copy; 2024 &middot; caf&eacute; &#8217;&#x2019;&#X2019; &amp;lt; &amp;amp;copy; &lt;b&gt; &quot;&apos;&#39;", "&notit; &copy2024 &copy=1 AT&T a & b &; &unknown; &#; &#x; &# 1",
        "&#0;&#128;&#xD800;&#1114112;&#99999999999;&#38;lt;", "plain", "\xa0 &foo\xa0bar", "ends with &copy", "&&amp;&", "中文 &hearts; \U0001f600 &NotEqualTilde;",
    ]
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{t}</p>") for i, t in enumerate(texts)] + [(90, "u", "<p>a&nbsp;b&#160;c&#xA0;d&nbspe</p>"), (91, "u", None)], "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in warc.derive(warc.responses(pages)).filter("warc_type = 'conversion'").collect()}
    for i, t in enumerate(texts):
        block = html.unescape(re.sub("[ \\t\\r\\f\\x0B]+", " ", t))
        assert rows[i]["block"] == block
        assert rows[i]["content_length"] == len(block.encode()) and rows[i]["block_digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
    assert rows[90]["block"] == "a b c d e" and rows[91]["block"] == ""


def test_warc_reads_and_writes(spark, tmp_path):
    body = b"<h1>Hi</h1>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(other) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record + other)
    found = warc.read_warc(spark, str(tmp_path)).collect()
    assert [r["record_id"] for r in found] == ["<urn:uuid:1>"] * 2 and {r["payload"] for r in found} == {body.decode()} and {r["payload_digest"] for r in found} == {"sha1:ABC"}
    lines = warc.serialised(warc.derive(warc.read_warc(spark, str(tmp_path)))).collect()
    assert len(lines) == 4 and all(r[0].startswith("WARC/1.1\r\n") and "WARC-Refers-To: <urn:uuid:1>" in r[0] for r in lines)


def test_warc_headers_are_linked(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nServer: a: b\r\nContent-Type: text/html\r\nX-Odd: é".encode("latin-1") + b"\r\n\r\n<p>Hi</p>"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n")
    made = {r["warc_type"]: r for r in warc.derive(warc.read_warc(spark, str(tmp_path))).collect()}
    for line in ("HTTP/1.1 200 OK", "Server: a: b", "Content-Type: text/html", "X-Odd: é"):
        assert f"source-http-header: {line}\r\n" in made["metadata"]["block"]
    assert f"source-payload-digest: sha256:{hashlib.sha256(b'<p>Hi</p>').hexdigest()}" in made["metadata"]["block"]
    for (value,), kind in zip(warc.serialised(warc.derive(warc.read_warc(spark, str(tmp_path))).orderBy("warc_type")).collect(), ("conversion", "metadata"), strict=True):
        head, _, block = value.removesuffix("\r\n\r\n").partition("\r\n\r\n")
        assert block == made[kind]["block"] and f"WARC-Block-Digest: sha256:{hashlib.sha256(block.encode()).hexdigest()}" in head and "Payload-Digest" not in head
        assert "WARC-Refers-To-Target-URI: http://x\r\n" in head and "WARC-Refers-To-Date: 2024-01-01T00:00:00Z\r\n" in head


def test_warc_clashes_empty_and_long(spark):
    page = "<p>" + "word &amp; é " * 400_000 + "</p>"
    rows = [("r1", "u", None, "text/html", page, None, "own text", "own block", 1, "t"), (None, None, None, None, None, None, None, None, None, None)]
    source = spark.createDataFrame(rows, warc.RESPONSE.replace(", http_headers string", "") + ", text string, block string, source_block int, _text string")
    found = warc.derive(source)
    assert found.columns == ["text", "source_source_block", "source_block", "_text", *warc.DERIVED]
    made = {(r["refers_to"], r["warc_type"]): r for r in found.collect()}
    assert len(made) == 4
    one = made["r1", "conversion"]
    assert one["text"] == "own text" and one["source_source_block"] == "own block" and one["source_block"] == 1 and one["_text"] == "t"
    assert one["block"] == ("word & é " * 400_000).strip() and one["content_length"] == len(one["block"].encode())
    assert made[None, "conversion"]["block"] == "" and made[None, "metadata"]["block"].startswith("source-record-id: \r\n")
    assert warc.derive(source.limit(0)).count() == 0


def test_sql_resolves_references_as_html_does():
    import html

    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id bigint, url text, html text)")
    every = " ".join(f"&{n}" for n in html.entities.html5)
    texts = [every, every.replace(";", ""), "".join(f"&#{i};&#x{i:x}" for i in range(14, 300)), "&notit; &copy2024 &copy=1 AT&T &; &unknown; &#; &#x; &#1114112; &#xD800; &#65534; &#x1FFFF;", "&#" + "9" * 60 + ";&#x0000041;", None]
    con.executemany("INSERT INTO pages VALUES (?, 'u', ?)", list(enumerate(texts)))
    got = {r[0]: r[-1] for r in con.execute(warc.oracle_derivatives()).fetchall() if r[1] == "conversion"}
    assert got == {i: warc.resolved(t or "") for i, t in enumerate(texts)}


# Licences


def test_license_base_and_templates(spark, tricky, nothing):
    notices = [(100, "Licensed under CC BY-NC 4.0. cc by"), (101, "x GENERAL Public License general public license"), (102, "words Released under the MIT License words"), (103, "all rights  reserved!"), (104, "the mit of this license"), (105, "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files (the Software), to deal in the Software without restriction")]
    rows = {r["doc_id"]: r for r in license_index.scan_licenses(spark.createDataFrame(rows_of(notices), SCHEMA).unionByName(tricky)).collect()}
    for i, t in notices + TEXTS:
        w = re.findall(ALNUM, (t or "").translate(LOWER))
        places = [k for p in license_index.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        if i is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert rows[100]["labels"] == "cc-by,cc-by-nc" and rows[102]["labels"] == "mit" and rows[102]["base_labels"] == "" and rows[104]["labels"] == "" and rows[105]["labels"] == "mit"
    assert 0.6 <= rows[105]["score"] < 1 and rows[3]["score"] == 0
    assert license_index.scan_licenses(nothing).count() == 0


def brute_licenses(text):
    """Labels and score: every template at every place, and the base phrases."""
    split = lambda t: re.findall(ALNUM, (t or "").translate(LOWER))
    w, best, slack = split(text), {}, license_index.SLACK
    for label, template, phrases in license_index.TEMPLATES:
        t = split(template)
        for d in range(-len(t), len(w) + 1):
            share = sum(any(0 <= d + q + s < len(w) and w[d + q + s] == x for s in range(-slack, slack + 1)) for q, x in enumerate(t)) / len(t)
            lo, hi = max(d - slack, 0), d + len(t) + slack
            inside = all(any(w[i : i + len(p)] == p for i in range(lo, min(hi, len(w)) - len(p) + 1)) for p in map(split, phrases))
            if share >= license_index.LEAST_SHARE and inside:
                best[label] = max(share, best.get(label, 0))
    base = {label for p, label in license_index.BASE.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
    return ",".join(sorted(base | set(best))), 1.0 if base else max([0.0, *best.values()])


def test_no_template_goes_untried(spark):
    """Words of a template that are common in the corpus, beside a notice whose words are rare."""
    rng = np.random.default_rng(5)
    full = [t for _, t, _ in license_index.TEMPLATES]
    hot = [(i, "Released under the MIT License") for i in range(30)]
    both = [(100, f"{full[1]}. {full[5]}."), (101, f"{full[5]}. {full[1]}."), (102, " ".join(full)), (103, " ".join(full[::-1]))]
    torn = []
    for i in range(60):
        words = " ".join(rng.choice(full, 3)).split()
        torn.append((200 + i, " ".join(x for w in words for x in ([] if rng.random() < 0.1 else [w, "more"] if rng.random() < 0.05 else [w]))))
    rows = {r["doc_id"]: r for r in license_index.scan_licenses(spark.createDataFrame(rows_of(hot + both + torn), SCHEMA)).collect()}
    assert rows[100]["labels"] == "bsd,mit"
    for i, t in hot + both + torn:
        labels, score = brute_licenses(t)
        assert rows[i]["labels"] == labels and rows[i]["score"] == pytest.approx(score)


# Sharding


def test_hilbert_curve_is_continuous():
    n = 1 << 3
    grid = np.indices((n, n, n)).reshape(3, -1)
    order = hilbert.hilbert_index(list(grid), 3)
    assert sorted(order.tolist()) == list(range(n**3))
    path = grid[:, np.argsort(order)]
    assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()


def test_shards_by_rows(tricky, nothing):
    rows = hilbert.shard_documents(tricky).collect()
    assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == counted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in rows)
    zones = hilbert.zone_map(hilbert.shard_documents(tricky), ["size"], 4)
    assert hilbert.prune(zones, size=(10**6, 10**7)).count() == 0 and hilbert.prune(zones, size=(0, 10**9)).count() == zones.count()
    assert hilbert.shard_documents(nothing).count() == 0


def test_every_dimension_prunes(spark):
    """A filter on one language, one source or one size leaves few runs, though few distinct values are no power of two."""
    import random

    rng = random.Random(4)
    langs, sources = ["de", "en", "es", "fr"], [f"https://host.example/{i:02}" for i in range(20)]
    rows = [(i, "w" * int(2 ** rng.uniform(3, 12)), rng.choice(langs), rng.choice(sources) if i % 3 else sources[0]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    sharded = hilbert.shard_documents(docs).cache()
    zones = hilbert.zone_map(sharded, ["lang", "source", "size"], 50).cache()
    n = zones.count()
    assert n == 80
    for lang in langs:
        assert hilbert.prune(zones, lang=(lang, lang)).count() <= n // 2
    for source in sources[1:]:
        assert hilbert.prune(zones, source=(source, source)).count() <= n // 2
    assert hilbert.prune(zones, size=(2000, 4000)).count() <= n // 2
    assert sharded.filter("shard < 4").select("lang", "source").distinct().count() < 80
    cells = hilbert.string_cells(docs, "source", 8)
    counts = collections.Counter(r[3] for r in rows)
    for k, v in enumerate(sorted(counts)):
        below = sum(counts[u] for u in sorted(counts)[:k])
        import pandas as pd

        assert cells.of(pd.Series([v, None])).tolist() == [below * 256 // 4000, 0]


def test_written_shards_keep_their_order(spark, tricky, tmp_path):
    sharded = hilbert.shard_documents(tricky)
    hilbert.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert counted((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == counted((r["doc_id"], r["shard"], r["slot"]) for r in sharded.collect())
    assert back.select("hilbert", "shard", "slot").orderBy("shard", "slot").agg({"slot": "count"}).first()[0] == len(TEXTS)


# Quality rules


def test_rule_counts(tricky, nothing):
    rows = adaptive_rules.judged(tricky).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        t = t or ""
        w = re.findall(SOLID, t)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(SOLID, x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    assert counted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert adaptive_rules.judged(nothing).count() == 0


def test_buckets_hold_their_values(spark):
    rows = spark.range(0, 5000).select("id", adaptive_rules.bucket(F.col("id")).alias("b")).withColumn("v", adaptive_rules.bucket_value(F.col("b"))).collect()
    for r in rows:
        assert r["v"] <= r["id"] <= r["v"] * 33 // 32 + 1
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_junk_is_dropped_and_clean_text_kept(spark):
    clean = [(i, " ".join(f"w{(i * 7 + k * k) % 997}x{k}" for k in range(80))) for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{k}*** %%%" for k in range(60))) for i in range(30)]
    rows = {r["doc_id"]: r["kept"] for r in adaptive_rules.judged(spark.createDataFrame(rows_of(clean + junk), SCHEMA)).collect()}
    assert all(rows[i] for i, _ in clean) and not any(rows[i] for i, _ in junk)


# Decontamination


BENCH = [(1, " ".join(f"b{k}" for k in range(25))), (2, "short Item of five words"), (3, None), (4, ""), (None, " ".join(f"n{k}" for k in range(12))), (5, " ".join(f"b{k}" for k in range(5, 20)))]


def contaminated_docs():
    first = BENCH[0][1]
    return [(200, "before " + first + " after"), (201, "x " + " ".join(first.split()[3:13]).upper() + " y"), (202, " ".join(first.split()[3:12])), (203, "SHORT item, of FIVE... words! short item of five words"), (204, " ".join(f"n{k}" for k in range(12))), (205, "b1 b2 b3 b4 b5 " + first + " b6 b7 b8 b9 b10 b11")]


@pytest.fixture(scope="module")
def benchmark_table(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


def brute_hits(text, items, window=10):
    w = re.findall(ALNUM, (text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        b = re.findall(ALNUM, (t or "").translate(LOWER))
        for k in range(max(1, len(b) - window + 1) if b else 0):
            p = b[k : k + window]
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit.update(range(a, a + len(p)))
                    found.add(i)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_contamination(spark, tricky, nothing, benchmark_table, limit, monkeypatch):
    monkeypatch.setattr(fm_index, "BENCHMARK_BYTES", limit)
    docs = spark.createDataFrame(rows_of(contaminated_docs()), SCHEMA).unionByName(tricky)
    rows = fm_index.contamination(docs, benchmark_table).collect()
    want = collections.Counter()
    for i, t in contaminated_docs() + TEXTS:
        n, hit, items = brute_hits(t, BENCH)
        want[i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0] += 1
    assert counted(rows) == want
    assert fm_index.contamination(nothing, benchmark_table).count() == 0
    assert fm_index.contamination(tricky, benchmark_table.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 400])
def test_removal_leaves_no_phrase(spark, tricky, benchmark_table, limit, monkeypatch):
    monkeypatch.setattr(fm_index, "BENCHMARK_BYTES", limit)
    docs = spark.createDataFrame(rows_of(contaminated_docs()), SCHEMA).unionByName(tricky)
    out = fm_index.decontaminated(docs, benchmark_table)
    assert out.columns == docs.columns
    assert fm_index.contamination(out, benchmark_table).filter("contaminated").count() == 0
    assert counted(r[:2] for r in out.collect() if r[0] is None or r[0] < 100) == collections.Counter(TEXTS)
    assert {r["doc_id"]: r["text"] for r in out.filter("doc_id = 200").collect()} == {200: "before\nafter"}


# Repeated strings


def brute_dedup(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("runs", [16_384, 2])
def test_suffix_dedup(tricky, nothing, runs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", 50)
    rows = suffix_dedup.deduplicated(tricky, shard_runs=runs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = collections.Counter((i, *x) for (i, _), x in zip(TEXTS, brute_dedup([t for _, t in TEXTS], 200), strict=True))
    assert counted(rows) == want
    assert suffix_dedup.deduplicated(nothing).count() == 0


def test_nothing_goes_but_by_suffix_arrays(monkeypatch):
    """Without the arrays' flags no window repeats: nothing else names one."""
    import pyarrow as pa

    found = suffix_dedup.repeated_windows

    class Slices:  # workers import the module anew, so the step is tried in this process
        repartition = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, solve, schema):  # noqa: N802
            return solve

    text = b"x" * 30 + bytes(range(97, 117)) * 9
    runs = np.array([[1, 2, 0, 4], [1, 3, 4, 7]], np.int64).tobytes()
    batch = pa.RecordBatch.from_pydict({"group": [1, 1, 1], "part": [0] * 3, "split": [False] * 3, "slot": [0, 1, 1], "piece": [text] * 3, "runs": [runs] * 3})
    ranges = lambda: [(r["run"], r["a"], r["b"]) for b in suffix_dedup.shard_windows(Slices(), 200, 1)(iter([batch])) for r in b.to_pylist()]
    assert ranges() == [(2, 0, 3), (3, 0, 6)]
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda *a: (lambda begin, flag, *rest: (begin, np.zeros_like(flag), *rest))(*found(*a)))
    assert ranges() == []


def test_repeats_across_sections(spark):
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 4_400_000, dtype=np.uint8)).decode()
    at = suffix_dedup.SECTION - 150
    texts = [(1, long[:at] + "#" * 400 + long[at:]), (2, "head " + "#" * 400 + long[at - 100 : at]), (3, long[4_000_000:4_000_300])]
    rows = {r["doc_id"]: r for r in suffix_dedup.deduplicated(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert rows[3]["n_removed"] == 300 and rows[1]["n_removed"] == 300 + 400 and rows[1]["n_spans"] == 2
    assert rows[2]["n_removed"] == 400 and rows[2]["n_spans"] == 1


def test_many_intervals_join_in_one_pass():
    own = [{"start": 10 * i, "stop": 10 * i + 5 + 6 * (i % 2)} for i in range(100_000)]
    assert len(suffix_dedup.joined(own)) == 50_001 and suffix_dedup.joined([]) == [] and suffix_dedup.joined([{"start": 1, "stop": 9}, {"start": 2, "stop": 3}, {"start": 9, "stop": 11}]) == [(1, 11)]


# Personal data


PII = [(300, "mail a.b+c@x-y.co.uk, ip 10.0.0.255 and 300.1.1.1"), (301, "card 4539 1488 0343 6467 or 4539-1488-0343-6468"), (302, "call +49 (30) 1234-5678 now"), (303, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (304, "é +1 (826) 555-4081 190.137.2.4 plain words"), (305, "1.2.3.4.5 and 4539148803436467")]


def test_personal_data(spark, tricky, nothing):
    docs = spark.createDataFrame(rows_of(PII), SCHEMA).unionByName(tricky)
    rows = {r["doc_id"]: r for r in crf_pii.personal_data(docs).collect()}
    assert rows[300]["base"] == ["email:5:20", "ip:25:35"] and rows[301]["n_base"] == [0, 0, 1, 0] and rows[302]["n_base"] == [0, 0, 0, 1]
    text = dict(PII)
    kinds = {i: {(s["kind"], text[i][s["start"] : s["stop"]]) for s in rows[i]["spans"]} for i in text}
    assert ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962") in kinds[303] and ("phone", "+1 (826) 555-4081") in kinds[304]
    for i, t in TEXTS:
        if i is not None:
            assert rows[i]["spans"] == []
    out = {r["doc_id"]: r["text"] for r in crf_pii.redacted(docs).collect()}
    assert out[300] == "mail <EMAIL>, ip <IP> and 300.1.1.1" and out[303] == 'token = "<SECRET>" end' and out[5] == dict(TEXTS)[5]
    assert crf_pii.personal_data(nothing).count() == 0


def plain_luhn(digits):
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def plain_base(text):
    """Base spans by their contract, kind by kind."""
    n = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m.group().split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(n(m)) <= 19 and plain_luhn(n(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(n(m)) <= 15]


def plain_labels(field, words):
    """Labels of one sentence's words by Viterbi, word after word."""
    from cladeworks.llm import textcore as tc

    rows = []
    for w in words:
        raw = w.encode()
        kinds = [int(crf_pii.SHAPE[b]) for b in raw]
        runs = [k for j, k in enumerate(kinds) if j == 0 or kinds[j - 1] != k][: crf_pii.RUNS]
        shape = sum((k + 1) * 17**j for j, k in enumerate(runs))
        data = tc.LOWER[np.frombuffer(raw, np.uint8)]
        cue = tc.span_hash(data, np.array([0]), np.array([len(raw)]))[0]
        digit = [k == 2 for k in kinds]
        changes = sum(digit[j] != digit[j - 1] and kinds[j] <= 3 and kinds[j - 1] <= 3 for j in range(1, len(raw)))
        place = lambda table, v: int(np.searchsorted(table, v)) + 1 if v in table else 0
        rows.append([place(field.shapes, shape), place(field.cues, cue), *(min(x, m - 1) for x, m in zip((len(raw), sum(digit), changes), crf_pii.SIZES, strict=True))])
    by = lambda o, r: sum(t[v] for t, v in zip(field.tables[o], r, strict=True))
    scores = [by(1, r) + (by(0, rows[j - 1]) if j else 0) + (by(2, rows[j + 1]) if j + 1 < len(rows) else 0) for j, r in enumerate(rows)]
    best, back = scores[0] + field.start, []
    for e in scores[1:]:
        route = best[:, None] + field.step
        back.append(route.argmax(0))
        best = route.max(0) + e
    label = [int(best.argmax())]
    for b in reversed(back):
        label.append(int(b[label[-1]]))
    return label[::-1]


def plain_spans(field, text):
    """All spans of a text: the base's, and the field's where no base span is."""
    base, own, sentence, at = plain_base(text), [], [], []
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for j, (a, b) in enumerate(words):
        sentence.append(text[a:b])
        at.append((a, b))
        ends = text[b - 1] in ".!?" and not re.search("[0-9]", text[a:b])
        if j + 1 < len(words) and not ends and "\n" not in text[b : words[j + 1][0]]:
            continue
        names = [crf_pii.LABELS[y] for y in plain_labels(field, sentence)]
        open_kind = None
        for name, (x, y) in zip(names, at, strict=True):
            kind = name.rstrip("+")
            if name.endswith("+") and kind == open_kind:
                own[-1] = (kind, own[-1][1], y)
            elif name != "O":
                own.append((kind, x, y))
            open_kind = None if name == "O" else kind
        sentence, at = [], []
    found = []
    for kind, a, b in own:
        cut = re.search("[=:]", text[a:b]) if kind == "secret" else None
        a += cut.end() if cut else 0
        edge = " \t\r\n\"'`,;:!?.*%$#&|<>"
        a, b = a + len(text[a:b]) - len(text[a:b].lstrip(edge)), a + len(text[a:b].rstrip(edge))
        if a < b and crf_pii.plausible(kind, text[a:b]) and not any(a < y and x < b for _, x, y in base):
            found.append((kind, a, b))
    return base, sorted(base + found, key=lambda s: (crf_pii.KINDS.index(s[0]), s[1]))


def test_personal_data_equals_a_plain_search(spark, tmp_path):
    """Every column of the query, over patterns, sentences of the field's own kind, and odd texts."""
    from cladeworks.llm import queries

    rows = [" ".join(w for w, _ in s) for s in crf_pii.labelled_table(60, seed=77)]
    texts = [*PII, *TEXTS, *[(400 + i, " \n".join(rows[i : i + 3])) for i in range(0, 60, 3)], (500, "x" * 40_000 + " 1" * 3000), (501, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 " * 50), (502, "a@b.c@d.e 1.2.3.4.5.6.7.8 999.1.1.1.1")]
    spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    field = crf_pii.default_field()
    want = collections.Counter()
    for i, t in texts:
        base, every = plain_spans(field, t or "")
        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(i, *(sum(k == name for k, _, _ in base) for name in ("email", "ip", "card", "phone")), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))] += 1
    got = queries.op7_crf_pii(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert counted(got) == want


def test_spans_do_not_depend_on_their_place(spark):
    texts = [(n, "filler " * n + "call (826) 555-4081") for n in (0, 1, *range(250, 262), 511, 512, 513, 3000)]
    for r in crf_pii.personal_data(spark.createDataFrame(rows_of(texts), SCHEMA)).collect():
        a = 7 * r["doc_id"] + 5
        assert [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] == [("phone", a, a + 14)]


def test_field_on_held_out_sentences():
    from cladeworks.llm import textcore as tc
    from cladeworks.llm.runtime import text_buffers
    import pyarrow as pa

    table = crf_pii.labelled_table(300, seed=5)
    field = crf_pii.default_field()
    data, offsets = text_buffers(pa.array([" ".join(w for w, _ in s) for s in table]))
    starts, ends, first = tc.word_spans(data, offsets, tc.SOLID)
    shape, cue, counts, _ = crf_pii.word_features(data, starts, ends)
    got = field.decode(field.emissions(field.values(shape, cue, counts), first[:-1]), first[:-1])
    gold = np.array([crf_pii.LABELS.index(y) for s in table for _, y in s])
    assert (got == gold).mean() > 0.99


def test_viterbi_is_the_best_sequence():
    import itertools

    rng = np.random.default_rng(4)
    k = crf_pii.N_LABELS
    field = crf_pii.Field(np.zeros(1), np.zeros(1, np.uint64), [], rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32))
    emission = rng.normal(size=(7, k)).astype(np.float32)
    got = field.decode(emission, np.array([0, 4]))
    for a, b in ((0, 4), (4, 7)):
        score = lambda y: field.start[y[0]] + sum(emission[a + t, y[t]] for t in range(b - a)) + sum(field.step[y[t], y[t + 1]] for t in range(b - a - 1))  # noqa: B023, E731
        assert tuple(got[a:b]) == max(itertools.product(range(k), repeat=b - a), key=score)


# Quality classifier


def labelled_documents(n):
    import random

    from .conftest import words

    rng = random.Random(8)
    texts = [(i, words(rng, rng.randint(5, 200)) + "." if i % 4 else words(rng, rng.randint(30, 200), "*** ") + " %%%") for i in range(n)]
    return texts, [(i, int(i % 4 > 0)) for i in range(n)]


def test_quality_scores(spark, tricky, nothing):
    texts, labels = labelled_documents(400)
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([*labels, (None, 1), (5000, 0), (7, None)], "doc_id bigint, quality int")
    model = attention_mil.train(docs, labels, limit=200)
    rows = attention_mil.score_documents(docs, model).withColumn("held", attention_mil.held_out("doc_id")).collect()
    held = [r for r in rows if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([(r["quality_score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in held]) > 0.95
    odd = attention_mil.score_documents(tricky, model)
    assert odd.columns == [c for c in tricky.columns if c != "quality_score"] + ["quality_score"]
    assert all(0 <= r["quality_score"] <= 1 for r in odd.collect()) and odd.count() == len(TEXTS)
    assert attention_mil.score_documents(nothing, model).count() == 0
    blank = attention_mil.train(docs, labels.limit(0))
    assert {r["quality_score"] for r in attention_mil.score_documents(docs, blank).collect()} == {0.5}


def plain_features(text):
    """Features of a text's passages, counted one by one."""
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    rows = []
    for k in range(0, max(len(words), 1), 64):
        own = words[k : k + 64]
        row = np.zeros(attention_mil.N_FEATURES)
        if own:
            begin, stop = (own[0][0] if k else 0), (words[k + 64][0] if k + 64 < len(words) else len(raw))
            n, c = stop - begin, attention_mil.N_CLASSES
            for i in range(begin, stop):
                kind = attention_mil.CLASS[raw[i]]
                row[kind] += 1 / n
                if i + 1 < len(raw):
                    row[c + int(kind) * c + int(attention_mil.CLASS[raw[i + 1]])] += 1 / n
            row = np.sqrt(row)
            long = np.array([b - a for a, b in own], float)
            row[-5:] = len({raw[a:b] for a, b in own}) / len(own), np.log1p(long.mean()), long.std() / 10, np.log1p(len(own)) / 5, (long <= 3).mean()
        rows.append(row)
    return np.array(rows)


def plain_score(model, text):
    """A text's score, passage by passage."""
    p, strengths, codes = model.parts, [], []
    for x in (plain_features(text) - model.mean) / model.scale:
        code = np.tanh(x @ p["w"] + p["b"])
        codes.append(code)
        strengths.append(float((np.tanh(code @ p["v"]) / (1 + np.exp(-(code @ p["u"])))) @ p["a"]))
    share = np.exp(np.array(strengths) - max(strengths))
    z = sum(c * s for c, s in zip(codes, share / share.sum(), strict=True))
    return 1 / (1 + np.exp(-(float(z @ p["c"]) + p["d"][0])))


def test_scores_equal_a_plain_pass(spark):
    """Every text by itself, whatever stands beside it in a batch."""
    texts, labels = labelled_documents(60)
    every = texts + [(i, t) for i, t in TEXTS if i is not None and len(t or "") < 20_000] + [(700, "  \n \t"), (701, "tail words after blanks   "), (702, "")]
    model = attention_mil.train(spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    rows = attention_mil.score_documents(spark.createDataFrame(rows_of(every), SCHEMA).coalesce(1), model).select("text", "quality_score").collect()
    assert len(rows) == len(every)
    for r in rows:
        assert abs(r["quality_score"] - plain_score(model, r["text"] or "")) < 1e-4


def test_training_reads_all_passages(spark, monkeypatch):
    got = []
    monkeypatch.setattr(attention_mil, "fit", lambda features, bounds, labels: got.append((len(features), bounds.tolist(), labels.tolist())))
    free = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame(rows_of([(free[0], "word " * (64 * 70)), (free[1], "one two")]), SCHEMA)
    attention_mil.train(docs, spark.createDataFrame([(free[0], 1), (free[1], 0)], "doc_id bigint, quality int"))
    assert got == [(71, [0, 70, 71], [1.0, 0.0])]


def test_attention_gradient():
    """Derivatives equal differences of the loss; training separates bags by one passage alone."""
    rng = np.random.default_rng(3)
    small = {"w": (5, 4), "b": (4,), "v": (4, 3), "u": (4, 3), "a": (3,), "c": (4,), "d": (1,)}
    model = attention_mil.Model(np.zeros(5), np.ones(5), {k: rng.normal(size=n) for k, n in small.items()})
    x, own = rng.normal(size=(9, 5)), np.array([0, 1, 4, 9])
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.25])
    _, grads = attention_mil.gradients(model, x, own, labels, weight)
    for k, part in model.parts.items():
        for at in np.ndindex(part.shape):
            was, sides = part[at], []
            for d in (1e-6, -1e-6):
                part[at] = was + d
                sides.append(attention_mil.gradients(model, x, own, labels, weight)[0])
            part[at] = was
            assert abs((sides[0] - sides[1]) / 2e-6 - grads[k][at]) < 1e-6
    rng = np.random.default_rng(0)
    bounds = np.arange(0, 601, 6)
    x = rng.normal(size=(600, attention_mil.N_FEATURES)).astype(np.float32) * 0.1
    y = (np.arange(100) % 2).astype(float)
    x[bounds[:-1][y == 1] + 2, :3] += 2
    model = attention_mil.fit(x, bounds, y)
    assert (((model.score(x, bounds) >= 0.5) == y).mean()) > 0.95


# Jaccard join


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = re.findall(SOLID, (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for a, (i, _) in enumerate(texts):
        if i is not None:
            ids[find(a)].append(i)
    return [(i, len(sets[a]), min(ids[find(a)], default=None)) for a, (i, _) in enumerate(texts)]


def near_copies():
    import random

    from .conftest import words

    rng = random.Random(9)
    out = []
    for g in range(6):
        base = words(rng, 150).split()
        for k in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = f"q{rng.randint(0, 99)}"
            out.append((1000 + g * 100 + k, " ".join(copy)))
    return out


def test_components(spark, tricky, nothing):
    texts = TEXTS + near_copies()
    docs = spark.createDataFrame(rows_of(near_copies()), SCHEMA).unionByName(tricky)
    rows = jaccard_join.near_duplicates(docs).collect()
    assert counted(rows) == collections.Counter(brute_components(texts))
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_large_sets_of_unlike_sizes(spark):
    import random

    from .conftest import words

    rng = random.Random(21)
    texts = []
    for g, n in enumerate((514, 516, 518, 1030, 2060, 9000)):
        base = [f"{g}x{i}" for i in range(n)]
        for k in range(4):
            copy = list(base)
            for _ in range(k * n // 90):
                copy[rng.randrange(n)] = f"q{rng.randint(0, 10**6)}"
            texts.append((10 * g + k, " ".join(copy[: n - 3 * k] + (["end"] * 5 if k == 3 else []))))
    texts += [(900 + k, words(rng, 3000)) for k in range(3)]
    rows = jaccard_join.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert counted(rows) == collections.Counter(brute_components(texts))
    full = jaccard_join.part_counts(np.arange(3000, dtype=np.uint64) << np.uint64(50))
    assert full.max() <= 127 and len(full) == 1024 and len(jaccard_join.part_counts(np.zeros(1, np.uint64))) == 128


def test_one_of_each_stays(tricky):
    kept = jaccard_join.one_of_each(tricky)
    assert kept.columns == tricky.columns
    want = {i for i, _, c in brute_components(TEXTS) if i is not None and i == c}
    got = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(got) == sorted(want)


def test_salted_shingles_lose_no_link(spark, tricky, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 3)
    docs = spark.createDataFrame(rows_of(near_copies()), SCHEMA).unionByName(tricky)
    assert counted(jaccard_join.near_duplicates(docs).collect()) == collections.Counter(brute_components(TEXTS + near_copies()))


def test_shuffled_path_gives_the_same(tricky, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", 0)
    assert counted(jaccard_join.near_duplicates(tricky).collect()) == collections.Counter(brute_components(TEXTS))


# Packing


def test_pieces_and_sequences(tricky, nothing):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for i, t in TEXTS:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(-(-len(ids) // 2048)):
            own = ids[p * 2048 : (p + 1) * 2048]
            want[i, p, p * 2048, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    rows = packing.pack(packing.token_pieces(tricky, VOCABULARY)).collect()
    assert counted(r[:5] for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(packing.token_pieces(nothing, VOCABULARY)).count() == 0


@pytest.mark.parametrize("text", ["Don't STOP! it's 3.14 <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "é ≠ a b c \u0085 d", "naïve…\"quote\" 中文 テスト ½ İI ſ K", "a.b,c;d: (e) [f] {g} h/i\\j k_l m-n 'o' ''p", "́ start ‍ joiner 👩‍👧 x\ty\nz\r\n"])
def test_cached_tokens_equal_whole_text_tokens(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cladeworks.llm.runtime import text_buffers

    ids, _ = packing.WordTokenizer(VOCABULARY).encode(*text_buffers(pa.array([text])), 0)
    assert ids.tolist() == [*Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    bins, offset = packing.vector_best_fit(lengths, max_tokens=100, max_docs=3, max_cost=5000, rule=rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and ((own**2).sum() <= 5000 or len(own) == 1)


def test_every_dimension_moves_pieces():
    """Each capacity, and each weight under the production capacities, changes where pieces go; none costs sequences there."""
    lengths = np.minimum(np.random.default_rng(5).lognormal(6, 1.2, 3000).astype(int) + 1, 2048)
    bound = -(-int(lengths.sum()) // 2048)
    plain = packing.vector_best_fit(lengths, weights=(1, 0, 0))[0]
    for weights in (packing.WEIGHTS, (1, 1, 0), (1, 0, 1)):
        moved = packing.vector_best_fit(lengths, weights=weights)[0]
        assert (moved != plain).any() and moved.max() + 1 <= bound * 1.01
    free = packing.vector_best_fit(lengths)[0]
    for more in ({"max_docs": 4}, {"max_cost": 2_000_000}):
        tight = packing.vector_best_fit(lengths, **more)[0]
        assert (tight != free).any()
        for b in np.unique(tight):
            own = lengths[tight == b].astype(float)
            assert own.sum() <= 2048 and len(own) <= more.get("max_docs", 2048) and ((own**2).sum() <= more.get("max_cost", 2048**2) or len(own) == 1)
    empty = packing.vector_best_fit(np.ones(5000, int))[0]
    assert np.bincount(empty).tolist() == [2048, 2048, 904]


def test_packed_ids_are_whole_sequences(tricky):
    pieces = packing.pack(packing.token_pieces(tricky, VOCABULARY, with_ids=True))
    by = collections.defaultdict(list)
    for r in pieces.collect():
        by[r["sequence_id"]].append((r["offset"], r["ids"]))
    assert {r["sequence_id"]: r["ids"] for r in packing.packed_ids(pieces).collect()} == {k: [i for _, ids in sorted(v) for i in ids] for k, v in by.items()}


def test_kept_rows_by_rules(spark):
    good, bad = "some plain words here. " * 3 + " ".join(f"w{i}" for i in range(80)), "too short"
    docs = spark.createDataFrame(rows_of([(1, good), (None, good), (2, bad), (2, good), (None, bad), (None, None)]), SCHEMA)
    assert counted((r["doc_id"], r["text"]) for r in adaptive_rules.kept_documents(docs).collect()) == counted([(1, good), (None, good), (2, good)])
    assert adaptive_rules.kept_documents(docs).columns == docs.columns and adaptive_rules.kept_documents(docs.limit(0)).count() == 0


def test_kept_rows_by_score(spark):
    texts, labels = labelled_documents(200)
    docs = spark.createDataFrame(rows_of([*texts, (None, texts[1][1]), (None, None)]), SCHEMA)
    kept = attention_mil.kept_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert kept.columns == docs.columns and {"x"} == {r["quality_score"] for r in kept.collect()}
    scored = attention_mil.score_documents(docs, attention_mil.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")))
    assert counted((r["doc_id"], r["text"]) for r in kept.collect()) == counted((r["doc_id"], r["text"]) for r in scored.collect() if r["quality_score"] >= 0.5)
    assert attention_mil.kept_documents(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_stage_operators_on_empty_tables(nothing, benchmark_table):
    for out in (jaccard_join.one_of_each(nothing), crf_pii.redacted(nothing), fm_index.decontaminated(nothing, benchmark_table)):
        assert out.columns == nothing.columns and out.count() == 0


def test_texts_longer_than_a_block(spark, benchmark_table):
    """One text beyond the bytes of a numpy pass, with what every operator looks for at its end, and a copy of it."""
    import random

    from tokenizers import Tokenizer

    from cladeworks.llm.runtime import BLOCK_BYTES

    rng = random.Random(12)
    body = " ".join(f"{rng.choice(('an', 'er', 'lo', 'ri', 'th'))}{rng.randint(0, 10**5)}é" for _ in range(260_000))
    phrase = max((t or "" for _, t in BENCH), key=len)
    tail = f" {phrase} . All rights reserved. mail a.b@c.org token = 04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = body + tail
    assert len(text.encode()) > BLOCK_BYTES * 1.2
    docs = spark.createDataFrame(rows_of([(1, text), (2, text), (3, "short text")]), SCHEMA)
    one = lambda df: {r["doc_id"]: r for r in df.collect()}[1]
    low = re.findall(ALNUM, text.translate(LOWER))
    found = one(license_index.scan_licenses(docs))
    at = max(i for i in range(len(low) - 2) if low[i : i + 3] == ["all", "rights", "reserved"])
    assert (found["n_words"], found["n_base"], found["first_word"], found["base_labels"]) == (len(low), 1, at, "reserved")
    n, hit, items = brute_hits(text, BENCH)
    got = one(fm_index.contamination(docs, benchmark_table))
    assert hit > 0 and (got["n_words"], got["n_hit"], got["n_items"]) == (n, hit, len(items))
    assert brute_hits(one(fm_index.decontaminated(docs, benchmark_table))["text"], BENCH)[1] == 0
    spans = [(s["kind"], text[s["start"] : s["stop"]]) for s in one(crf_pii.personal_data(docs.filter("doc_id = 1")))["spans"]]
    assert [s for s in spans if s[1] in tail] == [("email", "a.b@c.org"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    solid = re.findall(SOLID, text.translate(LOWER))
    rows = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert rows[1]["n_shingles"] == len({tuple(solid[i : i + 5]) for i in range(len(solid) - 4)}) and rows[2]["component_id"] == 1
    removed = one(suffix_dedup.deduplicated(docs))
    assert removed["n_removed"] == removed["n_bytes"] == len(text.encode()) and removed["n_spans"] == 1
    ids = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert sum(r["length"] for r in packing.token_pieces(docs, VOCABULARY).collect() if r["doc_id"] == 1) == len(ids) + 1
    counts = one(adaptive_rules.judged(docs))
    assert counts["n_words"] == len(solid) and counts["word_chars"] == sum(map(len, re.findall(SOLID, text))) and not counts["base_failed"]
    texts, labels = labelled_documents(40)
    model = attention_mil.train(spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert abs(one(attention_mil.score_documents(docs, model))["quality_score"] - plain_score(model, text)) < 1e-4
    assert one(hilbert.shard_documents(docs))["size"] == len(text.encode()) + 1


# Personal data in hostile texts

HOSTILE = ["see 111" + "." + "1" * 5000 + ".1.1", "1." * 3 + "0" * 6000 + "7", "9" * 1_000_000 + ".", "5" * 1_000_000, "x" * 1_000_000 + "@", "a." * 400_000 + "@b", "a@" * 200_000, "1." * 300_000, "+1" + "(" * 400_000, "a@b.c@d.e", "a@b.c.d@e.f g", "1.2.3.4.5.6.7.8.9", "1.2.3.256 1..2.3.4.5", "@@a@b..c.d"]


def test_patterns_are_linear_and_read_parts_of_any_length():
    import random
    import re
    import time

    from cladeworks.llm import crf_pii

    for text in HOSTILE:
        began = time.time()
        got = [s for s in crf_pii.base_spans(text) if s[0] in ("email", "ip")]
        assert time.time() - began < 2
        if len(text) < 20_000:
            small = lambda p: p.lstrip("0").rjust(3, "0") <= "255" and len(p.lstrip("0")) <= 3
            want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
            want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(map(small, m[0].split(".")))]
            assert got == want
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choice("12.@a-+ %025") for _ in range(rng.randint(1, 40)))
        got = [s for s in crf_pii.base_spans(text) if s[0] in ("email", "ip")]
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert got == want


def test_hostile_texts_pass_through_redaction(spark):
    from cladeworks.llm import crf_pii

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in crf_pii.personal_data(docs).collect()}
    out = {r["doc_id"]: r["text"] for r in crf_pii.redacted(docs).collect()}
    assert found.keys() == out.keys() == set(range(len(HOSTILE)))
    assert out[0].startswith("see ") and found[0]["n_base"] == [0, 0, 0, 0] and "<EMAIL>" in out[9] and "<IP>" in out[11]


# Texts around one passage


def test_blocks_of_sizes_meet_once_and_only_in_range():
    from cladeworks.llm import jaccard_join

    low = np.array([1, 5, 64, 100, 118, 999])
    high = low * 4 // 3
    rows, keys = jaccard_join.size_blocks(low, high)
    sizes = np.arange(1, 1500)
    at, own = jaccard_join.blocks_of(sizes, (75, 100))
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        met = sizes[at[np.isin(own, keys[rows == k])]]
        assert sorted(met.tolist()) == list(range(a, b + 1)) and (rows == k).sum() <= 30
    assert len(jaccard_join.size_blocks(np.array([9]), np.array([8]))[0]) == 0


def around_a_passage(n, sizes, seed=5):
    import random

    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(104))
    own = lambda i, k: " ".join(f"u{i}x{j}" for j in range(k))
    return [(i, passage + " " + own(i, rng.choice(sizes))) for i in range(n)]


@pytest.mark.parametrize("sizes", [[18], list(range(5, 40))])
def test_pairs_around_a_passage_grow_in_proportion(spark, monkeypatch, sizes):
    """A hundred shared shingles and a few own ones: no pair of equal sizes is similar, and only those that are meet."""
    from cladeworks.llm import jaccard_join

    met = []
    sides = jaccard_join.Join.sides

    def counted_sides(self, split):
        short, long = sides(self, split)
        count = lambda df, where: df.filter(where).groupBy("shingle", "block").count()
        for a, b in (("not main", "true"), ("main", "not main")):
            met.append(count(short, a).withColumnRenamed("count", "x").join(count(long, b).withColumnRenamed("count", "y"), ["shingle", "block"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0])
        return short, long

    monkeypatch.setattr(jaccard_join.Join, "sides", counted_sides)
    found = {}
    for n in (500, 2000, 8000):
        met.clear()
        docs = spark.createDataFrame(around_a_passage(n, sizes), "doc_id bigint, text string")
        parts = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
        found[n] = sum(met)
        # Sizes n, m are similar where 100 shared shingles are enough.
        texts = dict(around_a_passage(n, sizes))
        size = {i: len(t.split()) - 4 for i, t in texts.items()}
        small = min(size.values())
        alike = [i for i in size if 100 * 100 >= 75 * (size[i] + small - 100)]
        first = min(alike) if len(alike) > 1 else None
        assert all(parts[i] == (first if i in set(alike) and first is not None else i) for i in size)
    assert found[8000] <= 8 * max(found[2000], 1000)


# Pages that close nothing


def test_extraction_is_linear_and_equals_its_patterns():
    import random
    import time

    for piece in ("<script>", "<!--", "<", "<script", "<p", "</script ", "<style><!--", "&#" + "1" * 5000 + ";", "<script</script", "<template ", "&" * 9):
        text = piece * (1_000_000 // len(piece))
        began = time.time()
        warc.visible(text)
        warc.visible(text + "</script>")
        assert time.time() - began < 5, piece
    assert warc.visible("a&#" + "0" * 5000 + "65;&#" + "9" * 5000 + ";") == "aA\ufffd"
    rng = random.Random(4)
    parts = ["<script>", "</script>", "</SCRIPT >", "<script x='", "<style", "</style>", "<!--", "-->", "<", ">", "p", "<p>", "</p >", " ", "\n", "\t", "é", "<noscript>", "</noscript>", "<scripty>", "<b>", "<template>", "</template\t>", "-", "_", "<br/>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INT, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(texts)))
    rows = [{"i": i, "out": out} for i, out in con.execute(f"SELECT i, {warc.oracle_steps('t')} FROM x").fetchall()]
    assert [(texts[r["i"]], r["out"], warc.visible(texts[r["i"]])) for r in rows if r["out"] != warc.visible(texts[r["i"]])] == []


# Postings of licence words


def licence_rows(index, texts):
    out = []
    for t in texts:
        (hashes,) = license_index.words_of([t])
        at, word = index.numbers(hashes)
        place = dict(zip(at.tolist(), word.tolist(), strict=True))
        out.append(license_index.template_matches(license_index.positions(place), place, index))
    return out


def test_idf_decides_what_is_read_and_not_what_is_found():
    import dataclasses
    import random

    rng = random.Random(6)
    notices = [t for _, t, _ in license_index.TEMPLATES]
    texts = []
    for _ in range(300):
        w = rng.choice(notices).split()
        w = [x for x in w if rng.random() < rng.choice([0.6, 0.8, 1.0])]
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), rng.choice(["x", "license", "software", "the"]))
        texts.append(" ".join(["y"] * rng.randint(0, 5) + w + ["MIT License"] * rng.randint(0, 1)))
    index = license_index.template_index()
    first = licence_rows(index, texts)
    assert sum(map(bool, first)) > 50
    for seed in range(3):
        idf = np.random.default_rng(seed).random(len(index.vocabulary))
        other = dataclasses.replace(index, idf=idf)
        assert other.postings != index.postings and licence_rows(other, texts) == first
    for t, words in enumerate(index.templates):
        posted = sorted(q for ps in index.postings.values() for k, q in ps if k == t)
        assert len(posted) == len(words) - license_index.least_hits(len(words)) + 1


def test_postings_read_long_files_in_time():
    import time

    index = license_index.template_index()
    for text in ("Released under the MIT License " * 20_000, "license software permission " * 60_000, "mit " + "x " * 300_000 + "license", "hereby granted free of charge " * 30_000):
        began = time.time()
        licence_rows(index, [text])
        assert time.time() - began < 8


# Training within a budget


def test_training_holds_a_budget_of_bytes_and_counts_a_document_once(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:12]
    rows = [(i, ("good text here . " if i % 2 else "$$$ !!! ") * 20) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (500, None)], "doc_id bigint, quality int")
    of = lambda r: spark.createDataFrame(r, "doc_id bigint, text string")
    same = lambda a, b: all(np.array_equal(a.parts[k], b.parts[k]) for k in a.parts) and np.array_equal(a.mean, b.mean)
    plain = attention_mil.train(of(rows), labels)
    giant = [(i, t * 3000 if i == ids[3] else t) for i, t in rows]
    assert same(attention_mil.train(of(giant), labels, most_bytes=100_000), attention_mil.train(of([r for r in rows if r[0] != ids[3]]), labels))
    assert same(attention_mil.train(of(rows + [rows[0]] * 5 + [(ids[1], rows[1][1] + " and more")]), labels), plain)
    assert not same(attention_mil.train(of(giant), labels), plain)
    assert attention_mil.train(of(rows), labels, most_bytes=0).score(*attention_mil.passage_features(np.zeros(0, np.uint8), np.array([0, 0]))) == pytest.approx([0.5])


# Merging shards of one anchor


def test_any_cut_of_anchors_gives_the_same_and_needs_the_merge(spark, monkeypatch):
    """Finer cuts than the registered one lose removals without the merge, and nothing with it."""
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    total = lambda runs: suffix_dedup.deduplicated(docs, shard_runs=runs).agg(F.sum("n_removed"), F.sum(F.crc32(F.encode("kept_sha256", "UTF-8")))).first()
    whole, merged, asked = total(1 << 20), suffix_dedup.merged_shards, []

    def counted_merge(windows, shards):
        asked.append(windows.count())
        return merged(windows, shards)

    monkeypatch.setattr(suffix_dedup, "merged_shards", counted_merge)
    assert total(16) == total(1) == whole == total(suffix_dedup.SHARD_RUNS) and len(asked) == 2 and asked[0] > 0
    monkeypatch.setattr(suffix_dedup, "merged_shards", lambda windows, shards: merged(windows, shards).limit(0))
    assert total(1)[0] < whole[0]


def test_windows_with_zeros_are_told_apart(spark):
    end = lambda n: b"x" * 8 + b"\x00" * n + b"y" * (4 - n)
    rows = [(1, k, 0, 0, k % 2, w, False) for k, w in enumerate([end(0), end(1), end(2), end(2), end(4), end(4), b"\x00" * 12, b"\x00" * 12])]
    df = spark.createDataFrame([(a, r, x, y, p, bytearray(w), s) for a, r, x, y, p, w, s in rows], suffix_dedup.SOLVED)
    assert sorted(r["run"] for r in suffix_dedup.merged_shards(df, 3).collect()) == [2, 3, 4, 5, 6, 7]


def test_a_merge_looks_a_window_up_once_however_many_shards_there_are(monkeypatch):
    import pyarrow as pa

    class Windows:
        repartitionByRange = sortWithinPartitions = lambda self, *_: self  # noqa: N815

        def mapInArrow(self, merge, schema):  # noqa: N802
            return merge

    rng = np.random.default_rng(8)
    # A window that every shard has, some that a few have, some that one shard has twice.
    rows = [(b"m" * 12, p) for p in range(2000)] + [(rng.choice(list(b"\x00ab"), 12).astype(np.uint8).tobytes(), int(rng.integers(2000))) for _ in range(3000)] + [(b"z" * 12, 5)] * 2
    rows = sorted((w, k, p, bool(rng.random() < 0.3)) for k, (w, p) in enumerate(rows))
    shards = collections.defaultdict(set)
    for w, _, p, _ in rows:
        shards[w].add(p)
    sought, searched = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: (sought.append(np.size(v)), searched(a, v, *x, **y))[1])
    for step in (50, 1 << 16):
        sought.clear()
        monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", step)
        batches = [pa.RecordBatch.from_pydict({"anchor": [1] * len(b), "run": [k for _, k, _, _ in b], "a": [0] * len(b), "b": [0] * len(b), "part": pa.array([p for _, _, p, _ in b], pa.int32()), "window": [w for w, *_ in b], "settled": [s for *_, s in b]}) for b in (rows[i : i + 40] for i in range(0, len(rows), 40))]
        found = [k for out in suffix_dedup.merged_shards(Windows(), 1)(iter(batches)) for k in out.column("run").to_pylist()]
        assert sorted(found) == sorted(k for w, k, _, s in rows if not s and len(shards[w]) > 1)
        assert sum(sought) < 3 * len(rows)
