"""Split scans, stored responses and failure runs."""

import random

import pytest
from pyspark.sql import functions as F

from cladeworks.sources import lines, readers, responses
from cladeworks.streaming import failures, incremental


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (str(size), "1"), strict=True)]
    for n, v in before.items():
        spark.conf.set(n, v)


def scanned(df):
    return sorted((r["catalog"], r["line_no"], r["ordinal"], r["raw"]) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("closed", [True, False])
def test_splits_do_not_change_numbers(spark, tmp_path, small_splits, end, closed):
    rng = random.Random(1)
    texts = {f"{n}.src.txt": [" ".join("CNO"[rng.randint(0, 2)] * rng.randint(0, 30) for _ in range(rng.randint(0, 3))) for _ in range(rows)] for n, rows in (("beta", 400), ("alpha+x 1", 37), ("gamma", 1))}
    for name, rows in texts.items():
        (tmp_path / name).write_bytes((end.join(rows) + end * closed).encode())
    (tmp_path / "empty.src.txt").write_bytes(b"")
    want, before = [], 0
    for name in sorted(texts):
        rows = texts[name] if closed or texts[name][-1] else texts[name][:-1]
        want += [(name.removesuffix(".src.txt"), i + 1, before + i + 1, t) for i, t in enumerate(rows)]
        before += len(rows)
    scan = lambda: readers.catalogs(spark, str(tmp_path))
    small_splits(1 << 27)
    assert scanned(scan()) == sorted(want)
    small_splits((tmp_path / "beta.src.txt").stat().st_size // 50)
    split = scan()
    assert split.select(F.spark_partition_id()).distinct().count() >= 30
    assert scanned(split) == sorted(want)


def test_parts_of_a_catalog_count_on(spark, tmp_path, small_splits, monkeypatch):
    rows = spark.range(3000).select(F.concat(F.lit("C"), F.col("id") % 2).alias("catalog"), F.format_string("N%04d", "id").alias("value"))
    rows.repartitionByRange(6, "value").sortWithinPartitions("catalog", "value").write.partitionBy("catalog").text(str(tmp_path / "t"))
    small_splits(1000)
    want = sorted((f"C{k}", i + 1, k * 1500 + i + 1, f"N{2 * i + k:04}") for k in (0, 1) for i in range(1500))
    read = lambda: scanned(lines.numbered_lines(spark, str(tmp_path / "t" / "*"), lines.folder_value("catalog")))
    assert read() == want
    monkeypatch.setattr(lines, "BROADCAST_SPLITS", 3)
    assert read() == want


def test_lines_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.src.txt").write_bytes(b"C\xff A-1\n\n>>>CC B-2 more\n")
    got = readers.catalogs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["structure"], r["supplied"], r["supplier_code"], r["well_formed"]) for r in got] == [("C�", "C�", "A-1", True), (None, None, None, False), ("CC", ">>>CC", "B-2", True)]


def test_other_splits_than_counted_fail(spark, tmp_path, small_splits):
    (tmp_path / "x.txt").write_text("a\nb\n" * 500)
    df = lines.numbered_lines(spark, str(tmp_path / "x.txt"))
    small_splits(100)
    with pytest.raises(Exception, match="splits of a file changed"):
        df.collect()


def test_ordinals_need_no_window_over_a_catalog(spark):
    df = spark.createDataFrame([("b", i) for i in range(50)] + [("a", i) for i in range(3)], "catalog string, line_no bigint").repartition(4)
    got = sorted((r["catalog"], r["line_no"], r["ordinal"]) for r in readers.with_ordinal(df).collect())
    assert got == [("a", i, i + 1) for i in range(3)] + [("b", i, i + 4) for i in range(50)]


# Stored responses

BODY = '{"class":{"name":"x"}}'


def put(spark, path, rows):
    return responses.append_segment(spark.createDataFrame(rows, responses.SCHEMA).repartition(2), path)


def test_batch_and_stream_agree_and_a_restart_repeats_nothing(spark, tmp_path):
    path, table, at = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    put(spark, path, [("a", "s", 200, BODY, "1"), ("b", "s", 429, None, "1"), (None, None, None, None, None)])

    def drain():
        q = responses.stream_responses(spark, path).writeStream.format("parquet").option("path", table).option("checkpointLocation", at).trigger(once=True).start()
        q.awaitTermination()

    drain()
    assert put(spark, path, [("b", "s", 404, None, "2")]) == 1
    assert put(spark, path, [("c", "t", 500, "", "3")]) == 2
    drain()
    drain()
    key = lambda df: sorted(map(str, df.select("inchikey", "source", "http_status", "raw_json", "fetched_at").collect()))
    assert key(spark.read.parquet(table)) == key(responses.read_responses(spark, path)) and spark.read.parquet(table).count() == 5


def test_filters_reach_the_source(spark, tmp_path):
    path = str(tmp_path / "log")
    put(spark, path, [(k, "s", st, BODY, "1") for k in "abc" for st in (200, 404)])
    df = responses.read_responses(spark, path).filter("inchikey = 'b' AND http_status IN (200, 404) AND raw_json LIKE '%x%'")
    assert df.count() == 2
    reader = responses.Reader(path)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    more = GreaterThan(("http_status",), 3)
    assert list(reader.pushFilters([EqualTo(("inchikey",), "b"), In(("inchikey",), ("a", "b")), IsNotNull(("inchikey",)), more])) == [more]
    assert reader.equal == {"inchikey": ["b"]} and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_an_unfinished_segment_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    assert responses.segments(path) == []
    put(spark, path, [("a", "s", 200, BODY, "1")])
    (tmp_path / "log" / "seg=00000001").mkdir()
    assert responses.read_responses(spark, path).count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        put(spark, path, [("b", "s", 200, BODY, "1")])


def test_lookups_and_pages(spark, tmp_path):
    path = str(tmp_path / "log")
    page = lambda total, n: '{"page_meta":{"total_count":%d},"activities":[%s]}' % (total, ",".join(["{}"] * n))  # noqa: E731, UP031
    put(spark, path, [("a", "s", 404, None, "1"), ("a", "s", 200, BODY, "2"), ("p", "s", 200, page(2, 2), "1"), ("q", "s", 200, page(5000, 1200), "1"), ("r", "s", 200, "<html>", "1")])
    stored = responses.read_responses(spark, path)
    keys = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "inchikey string, source_row int")
    got = {r["inchikey"]: r["outcome"] for r in responses.lookup(keys, stored).withColumn("outcome", incremental.outcome(F.col("http_status"), F.col("raw_json"))).collect()}
    assert got == {"a": "HIT", "z": "NO_ANSWER", None: "NO_ANSWER"}
    assert {r[0]: tuple(r)[1:] for r in responses.activity_counts(stored.filter("inchikey > 'a'")).collect()} == {"p": (2, 2, False), "q": (5000, 1000, True), "r": (None, None, None)}


# Failure runs


def failure_events(n=400, hosts=5, seed=3):
    rng = random.Random(seed)
    bad = [rng.random() for _ in range(hosts)]
    return [(i, f"h{(h := rng.randrange(hosts))}", f"2024-01-01 {i // 60:02}:{i % 60:02}:00", None if rng.random() < 0.02 else rng.random() < 0.5 + bad[h] / 2) for i in range(n)]


EVENT = "at bigint, host string, time string, bad boolean"


def streamed(spark, tmp_path, cuts, rows, run_each=False):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    groups = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]

    def drain():
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src + "/*")
        found = failures.failure_stream(events, "host", "at", "time", F.col("bad"))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for k, g in enumerate(groups):
        spark.createDataFrame(g, EVENT).coalesce(1).write.parquet(f"{src}/{k:03}")
        if run_each:
            drain()
    drain()
    return spark.read.parquet(out)


def plain_runs(rows):
    state, out = {}, []
    for at, host, time, bad in rows:
        run, trips, until = state.get(host, (0, 0, -1))
        second = (int(time[11:13]) * 60 + int(time[14:16])) * 60
        run = run + 1 if bad else 0
        paused, tripped = second < until, run == failures.TRIP
        if tripped:
            trips += 1
            until = second + min(1800, 120 * trips)
        out.append((host, at, run, trips, tripped, paused))
        state[host] = (0 if tripped else run, trips, until)
    return sorted(out)


def as_events(df):
    return sorted((r["host"], r["at"], r["run"], r["trips"], r["tripped"], r["paused"]) for r in df.collect())


@pytest.mark.parametrize(("cuts", "run_each"), [([], False), ([1, 150, 151, 300], False), ([90, 200], True)])
def test_runs_do_not_depend_on_batches_or_restarts(spark, tmp_path, cuts, run_each):
    rows = failure_events()
    out = streamed(spark, tmp_path, cuts, rows, run_each)
    want = plain_runs(rows)
    assert as_events(out.filter("kind = 'event'")) == want
    assert any(w[4] for w in want) and any(w[5] for w in want)
    if len(cuts) == 2:  # timers: pauses that the watermark has passed are over
        resumed = out.filter("kind = 'resumed'").collect()
        assert resumed and len({(r["host"], r["until"]) for r in resumed}) == len(resumed)


def test_table_of_runs_equals_the_plain_loop(spark):
    rows = failure_events(900, 4, 9)
    df = spark.createDataFrame(rows, EVENT).repartition(3)
    assert as_events(failures.failure_table(df, "host", "at", "time", F.col("bad"))) == plain_runs(rows)
