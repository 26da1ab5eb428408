"""Versions, increments, artifacts, slots, audits, quantiles."""

import random
import statistics
import threading

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import artifacts, evaluate, hierarchy, ranges, slots
from cladeworks.sources import readers, sinks
from cladeworks.sources.versions import Conflict, VersionedTable
from cladeworks.streaming.derived import Derived


def ids(df):
    return sorted(r["id"] for r in df.collect())


# Versions


def test_versions_stay_readable(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "a table"))
    rows = lambda a, b: spark.range(a, b)
    assert t.latest() == 0
    with pytest.raises(ValueError, match="no version"):
        t.read()
    assert [t.replace(rows(0, 3)), t.append(rows(3, 5)), t.replace(rows(9, 10)), t.rewrite({"id": F.col("id") * 2}), t.roll_back(2)] == [1, 2, 3, 4, 5]
    assert [ids(t.read(v)) for v in t.versions()] == [[0, 1, 2], [0, 1, 2, 3, 4], [9], [18], [0, 1, 2, 3, 4]]
    assert t.manifest(5)["restored"] == 2 and t.manifest(4)["operation"] == "rewrite"
    with pytest.raises(ValueError, match="columns"):
        t.append(spark.createDataFrame([(1, 2)], "id bigint, x int"))
    assert ids(t.read()) == [0, 1, 2, 3, 4]
    none = VersionedTable(spark, str(tmp_path / "none"))
    none.replace(spark.createDataFrame([], "id bigint"))
    assert ids(none.read()) == []


def test_of_two_writers_one_fails_cleanly(spark, tmp_path):
    """All start from one version; exactly one commits, and the others leave no files."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(2))
    gate, won, lost = threading.Barrier(4), [], []

    def write(k):
        own = VersionedTable(spark, str(tmp_path / "t"))
        df = spark.range(10 * k, 10 * k + 1)
        folders = own.write_files(df)
        gate.wait()
        try:
            won.append((own.commit(1, "replace", folders, df.schema, folders), k))
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and len(lost) == 3 and won[0][0] == 2
    assert ids(t.read(2)) == [10 * won[0][1]] and ids(t.read(1)) == [0, 1] and t.versions() == [1, 2]
    assert len(t.files.names("data")) == 2 and not [n for n in t.files.names("log") if n.startswith(".")]
    with pytest.raises(Conflict):
        t.replace(spark.range(5), base=1)
    assert ids(t.append(spark.range(7, 8), base=1, retries=3) and t.read()) == [7, 10 * won[0][1]]


def test_frozen_versions_survive_vacuum(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(1))
    t.freeze("truth")
    with pytest.raises(Conflict):
        t.freeze("truth")
    t.replace(spark.range(2))
    t.replace(spark.range(3))
    assert len(t.vacuum(1)) == 1 and t.versions() == [1, 3]
    assert ids(t.frozen("truth")) == [0] and ids(t.read()) == [0, 1, 2]
    with pytest.raises(ValueError, match="no version 2"):
        t.read(2)


# Increments


def test_increments_equal_the_rebuild_after_every_batch(spark, tmp_path):
    rng = random.Random(2)
    kinds = {"n": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}
    d = Derived(spark, str(tmp_path / "d"), ["k", "j"], kinds)
    schema, seen = "k string, j int, v bigint", []
    for batch in range(4):
        rows = [(rng.choice(["a", "b", None, ""]), rng.choice([1, None]), rng.choice([None, rng.randint(-9, 9)])) for _ in range(30)] if batch != 2 else []
        seen += rows
        version = d.merge(spark.createDataFrame(rows, schema), batch)
        assert d.merge(spark.createDataFrame(rows, schema), batch) == version == d.table.latest()
        want = sorted(map(str, d.started(spark.createDataFrame(seen, schema)).collect()))
        assert sorted(map(str, d.read().collect())) == want
    assert d.merge(spark.createDataFrame([("z", 1, 1)], schema), 1) == 4 and d.read().filter("k = 'z'").count() == 0


def test_a_batch_rewrites_the_folders_of_its_keys_alone(spark, tmp_path):
    d = Derived(spark, str(tmp_path / "d"), ["k"], {"n": ("count", "k")})
    d.merge(spark.range(500).select(F.col("id").alias("k")), 0)
    before = set(d.table.manifest()["folders"])
    d.merge(spark.createDataFrame([(7,)], "k bigint"), 1)
    after = set(d.table.manifest()["folders"])
    assert len(before - after) == 1 and len(after - before) == 1
    assert {r["k"]: r["n"] for r in d.read().collect()} == {k: 1 + (k == 7) for k in range(500)}


# Artifacts


def test_digests_add_up_and_see_every_change(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (2, ""), (3, "x\x1fy")]
    df = spark.createDataFrame(rows, "k int, v string")
    whole = artifacts.digest(df, ["k", "v"]).first()
    assert artifacts.digest(df.repartition(3).orderBy(F.desc("k")), ["k", "v"]).first() == whole
    parts = artifacts.digest(df, ["k", "v"], [F.col("k").alias("part")])
    assert artifacts.added(parts).first() == whole and whole["n_rows"] == 5
    for other in ([(1, "a"), *rows[2:]], rows[:4] + [(3, "x")], rows + [(1, "a")]):
        assert artifacts.digest(spark.createDataFrame(other, "k int, v string"), ["k", "v"]).first()["digest"] != whole["digest"]
    assert artifacts.digest(df.limit(0), ["k", "v"]).first()["digest"] == "0" * 32
    changed = artifacts.changed_rows(df, spark.createDataFrame([(1, "a"), (1, "b"), *rows[2:]], "k int, v string"), ["k", "v"], ["k"])
    assert sorted(map(tuple, changed.collect())) == [("1", "a", "left", 1), ("1", "b", "right", 1)]
    assert artifacts.changed_rows(df, df, ["k", "v"], ["k"]).collect() == []


def test_reruns_restore_settings(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    turn = iter([10, 10, 11])
    got = artifacts.reruns(spark, lambda: spark.range(next(turn)).toDF("k"), ["k"], [{name: "2"}, {name: "3"}, {name: "5"}]).orderBy("run").collect()
    assert [r["agrees"] for r in got] == [True, True, False] and spark.conf.get(name) == before


def test_graphml_of_many_parts(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i:03}", f'a "{i}" & <b>\n' if i % 3 else None) for i in range(60)], "class_id string, name string")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "is_a") for i in range(59)], "parent_id string, child_id string, relation string")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = readers.graphml(spark, str(tmp_path / "g"), ["name"])
    assert sorted(map(str, n.collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(tuple, e.collect())) == sorted((r["parent_id"], r["child_id"]) for r in edges.collect())
    from xml.etree import ElementTree

    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ElementTree.fromstring(text)
    assert len(root.findall(".//{*}node")) == 60 and len(root.findall(".//{*}edge")) == 59


# Slots


def test_bitmaps_equal_sets(spark):
    rng = random.Random(7)
    items = [f"i{k:06}" for k in range(40_000)]
    facts = [(f"r{rng.randint(0, 2)}", rng.randint(0, 2), rng.choice(items[:: rng.choice([1, 997])])) for _ in range(3000)] + [("r0", 0, None), ("only", 1, "i000001")]
    df = spark.createDataFrame(facts, "reaction string, slot int, item string")
    places = slots.numbered(spark.createDataFrame([(i,) for i in items], "item string"), "item")
    of = lambda r, k: {i for x, s, i in facts if x == r and s == k and i is not None}
    maps = slots.bitmaps(df, ["reaction", "slot"], "item", places)
    assert {(r["reaction"], r["slot"]): r["n"] for r in slots.sizes(maps, ["reaction", "slot"]).collect()} == {(r, k): len(of(r, k)) for r, k, i in facts if i is not None}
    got = {r["reaction"]: tuple(r)[1:] for r in slots.slot_pairs(df, "reaction", "slot", "item").collect()}
    for r in ("r0", "r1", "r2", "only"):
        a, b = of(r, 0), of(r, 1)
        assert got[r] == (len(a), len(b), len(a & b), sum(len(b - {x}) for x in a))
    classes = spark.createDataFrame([("even" if k % 2 == 0 else "odd", i) for k, i in enumerate(items)], "class string, item string")
    found = {(r["class"], r["slot"]): r["n"] for r in slots.overlaps(slots.bitmaps(classes, ["class"], "item", places), slots.bitmaps(df, ["slot"], "item", places)).collect()}
    every = {k: {i for _, s, i in facts if s == k and i is not None} for k in (0, 1, 2)}
    assert found == {(c, k): n for c, odd in (("even", 0), ("odd", 1)) for k in every if (n := sum(int(i[1:]) % 2 == odd for i in every[k]))}


def test_slots_of_few_items_take_few_bytes(spark):
    facts = [(r, k, 40_000 * r // 300 + 997 * k * i) for r in range(300) for k in (0, 1) for i in (1, 2)]
    df = spark.createDataFrame([*facts, (None, 0, 5), (None, 1, 5)], "reaction int, slot int, item int")
    places = slots.numbered(spark.range(50_000).select(F.col("id").cast("int").alias("item")), "item")
    maps = slots.bitmaps(df, ["reaction", "slot"], "item", places).collect()
    assert sum(len(r["bits"]) if isinstance(r["bits"], (bytes, bytearray)) else 8 for r in maps) <= 8 * (len(facts) + 2)
    got = {r["reaction"]: tuple(r)[1:] for r in slots.slot_pairs(df, "reaction", "slot", "item").collect()}
    assert got == {r: (1, 2, 0, 2) for r in range(300)} | {None: (1, 1, 0, 1)}


def test_tasks_grow_in_number(spark):
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranges.enough_parts(spark.range(1000), 10) == 100 and ranges.enough_parts(spark.range(3), 10) == at_least


# Audits and quantiles


def test_one_row_says_all_of_a_topology(spark):
    terms = spark.createDataFrame([("T:0", [], False), ("T:1", ["T:0"], False), ("T:2", ["T:1", "T:0"], True), ("T:3", ["T:99"], None), ("T:4", None, False)], "node string, parents array<string>, obsolete boolean")
    r = hierarchy.topology_audit(terms).first()
    assert r.asDict() == {"n_terms": 5, "n_edges": 4, "n_roots": 2, "roots": "T:0;T:4", "n_multi_parent": 1, "n_obsolete": 1, "n_dangling": 1, "n_cycle_nodes": 0, "max_depth": 2, "histogram": "0=3 1=1 2=1", "acyclic": True}
    loop = hierarchy.topology_audit(spark.createDataFrame([("a", ["b"], False), ("b", ["a"], False), ("c", ["c"], False)], terms.schema)).first()
    assert (loop["n_cycle_nodes"], loop["acyclic"], loop["n_roots"]) == (3, False, 0)
    none = hierarchy.topology_audit(terms.limit(0)).first()
    assert (none["n_terms"], none["acyclic"], none["max_depth"], none["histogram"]) == (0, True, None, "")


def test_family_rows_and_the_collapsed_group(spark):
    groups = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "group_id int, name string")
    families = spark.createDataFrame([(1, "y"), (1, "x"), (2, "p"), (2, "q"), (9, "lost")], "group_id int, name string")
    rows = lambda **kw: [tuple(r)[1:4] for r in hierarchy.family_rows(groups, families, **kw).orderBy("position").collect()]
    assert rows(collapsed=["a"]) == [(1, "a", "group"), (2, "(2 families)", "collapsed"), (1, "b", "group"), (2, "x", "leaf"), (2, "y", "leaf"), (1, "c", "group")]
    assert [r[1] for r in rows(descending=True)] == ["c", "b", "x", "y", "a", "p", "q"]


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "parent_id int, child_id int")
    with pytest.raises(RuntimeError, match="still change after 2 rounds"):
        hierarchy.weak_components(chain, max_rounds=2)


@pytest.mark.parametrize("values", [[], [3], [1, 2], [5, 5, 5, 1], None])
def test_quantiles_equal_sorted_values(spark, values):
    rng = random.Random(1)
    values = [round(rng.gauss(0, 9), 2) for _ in range(501)] + [7.5] * 400 if values is None else [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    r = evaluate.exact_quantiles(df, "v", {"least": 0.0, "q": 0.25, "mid": 0.5, "most": 1.0}).first()
    assert "Python" not in df._jdf.queryExecution().toString()
    if not values:
        assert tuple(r) == (None,) * 4
        return
    s = sorted(values)
    at = lambda q: s[int((len(s) - 1) * q)] + ((len(s) - 1) * q % 1) * (s[min(int((len(s) - 1) * q) + 1, len(s) - 1)] - s[int((len(s) - 1) * q)])
    assert tuple(r) == pytest.approx((s[0], at(0.25), statistics.median(s), s[-1]))


# Stored tables, sentinels, islands


def test_stored_tables_can_be_cleared(spark):
    from cladeworks import storage

    df = storage.stored(spark.range(5))
    assert df.count() == 5 and storage.clear(spark) >= 1 and storage.clear(spark) == 0
    with pytest.raises(Exception, match="(?i)does not exist|FAILED_READ|NOT_EXIST"):
        df.count()


def test_of_several_runs_one_marks_the_end(spark, tmp_path):
    path, out = str(tmp_path / "done"), []
    threads = [threading.Thread(target=lambda k=k: out.append(sinks.mark_done(spark.range(k, k + 1), path))) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out) == [False, False, True] and sinks.is_done(spark, path) and not sinks.mark_done(spark.range(1), path)


def test_runs_over_ranges_equal_a_loop(spark):
    from cladeworks.streaming import incremental

    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.choice([True, True, True, False, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "host string, at int, bad boolean").repartition(3)
    state, want = {}, []
    for host, at, bad in rows:
        state[host] = state.get(host, 0) + 1 if bad else 0
        want.append((at, state[host], state[host] >= 4))
    got = sorted((r["at"], r["run"], r["tripped"]) for r in incremental.breaker(df, "host", "at", F.col("bad"), trip=4).collect())
    assert got == want
    lengths = sorted(r["n"] for r in incremental.run_lengths(df, "host", "at", F.col("bad")).collect())
    ends = []
    for h in ("hot", "cold", None):
        own = [w[1] for r, w in zip(rows, want, strict=True) if r[0] == h]
        ends += [a for a, b in zip(own, [*own[1:], 0], strict=True) if a and b != a + 1]
    assert lengths == sorted(ends)


def test_a_representative_of_several_rows_has_one_answer(spark):
    from cladeworks.operators import enrich

    rep = spark.createDataFrame([(1, "a", 5), (1, "b", None), (1, None, 9), (2, None, None)], "k int, x string, y int").repartition(3)
    got = {r["id"]: (r["x"], r["y"]) for r in enrich.back_propagate(spark.createDataFrame([(7, 1), (8, 2), (9, 3), (10, None)], "id int, k int"), rep, "k", ["x", "y"]).collect()}
    assert got == {7: ("b", None), 8: (None, None), 9: (None, None), 10: (None, None)}


# Predictors and locks


def test_predictors_fail_text_by_text(spark):
    from cladeworks.operators import predict

    def guess(text):
        if text == "bad":
            raise KeyError(text)
        return (text[:1] or None), ["z", None, text[:1], "z"]

    def many(texts):
        if "bad" in texts:
            raise ValueError
        return [guess(t) for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None), (4, "ab")], "id int, primary string").withColumnRenamed("primary", "t")
    for batch in (None, many):
        got = {r["id"]: (r["primary"], r["candidates"], r["failure"]) for r in predict.predicted(df, "t", guess, batch).collect()}
        assert got == {1: ("a", ["a", "z"], None), 2: (None, [], "KeyError"), 3: (None, ["z", ""], None), 4: ("a", ["a", "z"], None)}
    lines = predict.with_lineage(predict.predicted(df, "t", guess), spark.createDataFrame([("a", ["r", "a"])], "node string, path array<string>"))
    assert {r["id"]: r["lineage"] for r in lines.collect()} == {1: ["r", "a"], 2: [], 3: [], 4: ["r", "a"]}


def test_one_job_holds_a_lock(spark, tmp_path):
    from cladeworks.sources.versions import Lock

    clock = [100.0]
    lock = lambda: Lock(spark, str(tmp_path), "rebuild", 60, lambda: clock[0])
    with lock():
        with pytest.raises(Conflict), lock():
            pass
        clock[0] = 130.0
        with pytest.raises(Conflict), Lock(spark, str(tmp_path), "rebuild", 60, lambda: clock[0]):
            pass
        with Lock(spark, str(tmp_path), "other", 60):
            pass
    with lock():  # it was given back
        clock[0] = 500.0
        with lock():  # the first holder's time is over
            with pytest.raises(Conflict), lock():
                pass
