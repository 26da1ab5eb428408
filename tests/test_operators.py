import collections
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import dedup, enrich, evaluate, hierarchy, quality, rules, sampling, splits, standardize
from cladeworks.plans import catalogue, demo_rules as demo
from cladeworks.sources import readers, sinks
from cladeworks.streaming import incremental


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "parent_id string, child_id string")


def as_map(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


# Hierarchies


def test_diamond_and_shortcut(spark):
    diamond = edges_of(spark, *[tuple(x) for x in ("ab", "ac", "bd", "cd")])
    assert as_map(hierarchy.depths(diamond), "node", "depth") == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert as_map(hierarchy.primary_path(diamond), "node", "path")["d"] == ["a", "c", "d"]
    assert as_map(hierarchy.tree_projection(diamond), "child_id", "parent_id") == {"b": "a", "c": "a", "d": "c"}
    shortcut = edges_of(spark, *[tuple(x) for x in ("ab", "bc", "ac")])
    assert as_map(hierarchy.depths(shortcut), "node", "depth")["c"] == 2 and as_map(hierarchy.tree_projection(shortcut), "child_id", "parent_id")["c"] == "b"


def test_closure_on_random_graphs(spark):
    rng = random.Random(1)
    pairs = {(f"n{a}", f"n{b}") for a, b in ((rng.randint(0, 11), rng.randint(0, 11)) for _ in range(16)) if a != b}
    want = set(pairs)
    while True:
        more = {(a, d) for a, b in want for c, d in want if b == c and a != d} - want
        if not more:
            break
        want |= more
    got = {tuple(r) for r in hierarchy.closure(edges_of(spark, *pairs)).select("ancestor", "node").collect()}
    assert got == want


def test_cycles_forests_and_components(spark):
    cycle = edges_of(spark, *[tuple(x) for x in ("ab", "bc", "ca")])
    assert not hierarchy.is_acyclic(cycle) and {r[0] for r in hierarchy.cycle_nodes(cycle).collect()} == {"a", "b", "c"}
    forest = edges_of(spark, ("a", "b"), ("x", "y"))
    assert hierarchy.is_acyclic(forest) and hierarchy.degree_stats(forest).first()["n_roots"] == 2
    assert len(set(as_map(hierarchy.weak_components(forest), "node", "component").values())) == 2
    assert not hierarchy.is_acyclic(edges_of(spark, ("a", "a")))


def test_cycle_nodes_on_random_graphs(spark):
    rng = random.Random(5)
    pairs = {(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randint(0, 24), rng.randint(0, 24)) for _ in range(32))}
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            break
        reach |= more
    graph = edges_of(spark, *pairs)
    assert {r[0] for r in hierarchy.cycle_nodes(graph).collect()} == {a for a, b in reach if a == b}
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.depths(graph)
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.depths(edges_of(spark, ("a", "b"), ("b", "a")))


def test_a_million_edges(spark):
    wide = spark.range(1_200_000).select(F.concat(F.lit("p"), F.col("id") % 7).alias("parent_id"), F.concat(F.lit("c"), F.col("id")).alias("child_id"))
    wide = wide.union(spark.range(7).select(F.lit("root"), F.concat(F.lit("p"), F.col("id"))))
    sizes = hierarchy.subtree_sizes(wide)
    assert as_map(sizes.filter("node = 'root' or node = 'p3'"), "node", "n_descendants") == {"root": 1_200_007, "p3": 171_429 if 1_200_000 % 7 > 3 else 171_428}
    assert hierarchy.depths(wide).agg(F.sum("depth")).first()[0] == 2 * 1_200_000 + 7


def test_many_levels_and_many_paths(spark):
    chain = edges_of(spark, *[(f"n{i:03}", f"n{i + 1:03}") for i in range(110)])
    assert hierarchy.depths(chain).agg(F.max("depth")).first()[0] == 110
    assert len(hierarchy.deepest_path(chain, "n100").first()[0]) == 11 and hierarchy.deepest_path(chain, "x' or 1=1 --").count() == 0
    ladder = edges_of(spark, *[e for i in range(40) for e in ((f"t{i:02}", f"l{i:02}"), (f"t{i:02}", f"r{i:02}"), (f"l{i:02}", f"t{i + 1:02}"), (f"r{i:02}", f"t{i + 1:02}"))])
    assert as_map(hierarchy.primary_path(ladder), "node", "path")["t40"] == [x for i in range(40) for x in (f"t{i:02}", f"r{i:02}")] + ["t40"]
    assert as_map(hierarchy.tree_projection(ladder), "child_id", "parent_id")["t07"] == "r06"


def test_capped_subtrees_and_lineages(spark):
    tree = edges_of(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("x", "a"), ("c", "e"))
    assert {tuple(r) for r in hierarchy.capped_subtree(tree, "a", 3).collect()} == {("a", 0, "a", 0), ("b", 1, "a/b", 2), ("c", 1, "a/c", 1)}
    assert [tuple(r) for r in hierarchy.capped_subtree(tree, "e").collect()] == [("e", 0, "e", 0)] and hierarchy.capped_subtree(tree, "nobody").count() == 0
    terms = spark.createDataFrame([(f"t{i}", [f"t{i - 1}"] if i else []) for i in range(40)] + [("p", ["q"]), ("q", ["r"]), ("r", ["q"]), ("s", ["s"]), ("u", ["gone"]), ("v", None), ("w", ["p"])], "node string, parents array<string>")
    found = as_map(hierarchy.first_parent_lineage(terms), "node", "lineage")
    assert found["t39"] == [f"t{i}" for i in range(39, -1, -1)] and found["p"] == ["p", "q", "r"] and found["q"] == ["q", "r"] and found["r"] == ["r", "q"] and found["w"] == ["w", "p", "q", "r"]
    assert found["s"] == ["s"] and found["u"] == ["u"] and found["v"] == ["v"] and len(found) == 47


def test_rule_set_invariants(spark):
    names = ["red ring", "blue bolt", "hot gear", "old thing", None]
    rows = [(i, names[i % 5], ["ECONOMY", "PROMO", "MEDIUM", None][i % 4], i % 50, 900.0 + i) for i in range(120)]
    df = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double")
    facts = rules.membership(df, "p_partkey", demo.PARTS).collect()
    above, own = demo.PARTS.ancestors(), collections.defaultdict(dict)
    for f in facts:
        assert f["class_id"] not in own[f["item_id"]]
        own[f["item_id"]][f["class_id"]] = f
    assert len(own) == 120
    for item in own.values():
        assert sum(f["is_primary"] for f in item.values()) == 1
        assert all(a in item for c in item for a in above[c])
    for r in rules.primary_paths(df, "p_partkey", demo.PARTS).collect():
        assert r["node_path"][0] == "0001" and r["node_path"][-1] == r["primary_class"]
        assert all((a, b) in demo.EDGES for a, b in zip(r["node_path"], r["node_path"][1:]))
    depth = {k: len(v) for k, v in demo.PARTS.paths().items()}
    assert all(depth[c] > depth[p] for p, c in demo.EDGES)


# Deduplication, enrichment, quality


def test_first_wins_and_incremental(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "a")], "id bigint, k string")
    got = {(r["duplicate"], r["representative"]) for r in dedup.duplicate_mapping(df, "k", "id", ["id"]).collect()}
    assert got == {(3, 1), (5, 1)}
    assert {r["id"] for r in dedup.representatives(df, "k", ["id"]).collect()} == {1, 2, 4}
    new, old = dedup.merge_incremental(df.filter("k is not null"), spark.createDataFrame([(0, "b")], "id bigint, k string"), "k", "id", ["id"])
    assert {r["id"] for r in new.collect()} == {1} and {(r["duplicate"], r["representative"]) for r in old.collect()} == {(2, 0), (3, 1), (5, 1)}


def test_only_unambiguous_values_resolve(spark):
    mapping = spark.createDataFrame([("k1", "z1"), ("k1", "z1"), ("k2", "z1"), ("k2", "z2"), ("k3", None)], "k string, z string")
    facts = spark.createDataFrame([("k1",), ("k2",), ("k3",), (None,)], "k string")
    assert {r["k"]: r["z"] for r in enrich.resolve(facts, mapping, ["k"], "z").collect()} == {"k1": "z1", "k2": None, "k3": None, None: None}


def test_verdict_names_failed_checks(spark):
    df = spark.createDataFrame([(1, 0), (1, 2)], "id bigint, flag int")
    v = quality.Checks(spark).add("key", quality.duplicate_keys(df, ["id"])).none_where("flag", df, ~F.col("flag").isin(0, 1), "warning").verdict().first()
    assert (v["status"], v["errors"], v["warnings"]) == ("FAIL", ["key"], ["flag"])
    assert quality.difference(df, df).count() == 0 and quality.table_digest(df, ["id", "flag"]).first() == quality.table_digest(df.orderBy(F.desc("flag")), ["id", "flag"]).first()


# Splits, metrics, samples


def test_split_equals_greedy_fill(spark):
    import hashlib

    rng = random.Random(2)
    sizes = {f"g{i}": rng.randint(1, 40) for i in range(30)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    total = sum(sizes.values())
    want, test, val = {}, 0, 0
    for g in sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5(("20260722" + g).encode()).hexdigest())):
        if test < int(total * 0.15):
            want[g], test = "test", test + sizes[g]
        elif val < int(total * 0.15):
            want[g], val = "validation", val + sizes[g]
        else:
            want[g] = "train"
    got = splits.group_split(df, "g")
    assert as_map(got, "g", "split") == want and splits.leakage(got, "g").count() == 0


def test_flags_are_null_where_truth_is_missing(spark):
    df = spark.createDataFrame([("a", ["a"], ["r", "x", "s", "c"], ["s", None], "a", "s", None), (None, [], [], ["s"], "t", None, "c")], "predicted string, candidates array<string>, lineage array<string>, levels array<string>, terminal string, truth_super string, truth_class string")
    a, b = evaluate.hierarchical_flags(df).collect()
    assert (a["exact"], a["on_path"], a["super_ok"], a["class_ok"]) == (True, False, True, None) and (b["exact"], b["super_ok"], b["class_ok"]) == (False, None, False)


def test_wilson_matches_the_published_interval(spark):
    low, high = evaluate.wilson(F.lit(80.0), F.lit(149.0))
    row = spark.range(1).select(F.round(low, 4), F.round(high, 4)).first()
    assert tuple(row) == (0.4569, 0.6150)


def test_nearest_and_farthest(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for r in sampling.nearest(df.filter("id < 10"), df.filter("id >= 10")).collect():
        best = max((round(cos(rows[r["query_id"]][1], v), 6), -i) for i, v in rows[10:])
        assert (r["similarity"], -r["item_id"]) == best
    picks = [r["id"] for r in sampling.farthest_points(df, 4).collect()]
    assert len(set(picks)) == 4


def test_query_rows_are_items_of_each_other(spark, tmp_path):
    vectors = [(50, [1.0, 0.0]), (100, [1.0, 0.0]), (150, [0.0, 0.0]), (1, [0.6, 0.8]), (2, [-1.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalogue.QUERIES["max_similarity_bucket"](spark, str(tmp_path)).collect()
    assert {r["query_id"]: (r["similarity"], r["bucket"]) for r in rows} == {50: (1.0, ">=0.7"), 100: (1.0, ">=0.7"), 150: (0.0, "<0.3")}
    df = spark.createDataFrame([(50, [1.0])], "id bigint, vector array<double>")
    assert sampling.nearest(df, df, but_itself=True).count() == 0


def test_leakage_is_audited_over_documents(spark, tmp_path, monkeypatch):
    sources = ["a"] * 6 + ["b"] * 3 + ["c"] * 2 + [None]
    spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id bigint, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda: {r["split"]: (r["n_rows"], r["n_groups"], r["n_leaking"]) for r in catalogue.QUERIES["split_leakage"](spark, str(tmp_path)).collect()}
    own = found()
    assert sum(r[0] for r in own.values()) == 12 and sum(r[1] for r in own.values()) == 4 and {r[2] for r in own.values()} == {0} and None not in own
    wrong = spark.createDataFrame([("a", 1, "test"), ("a", 1, "train"), ("b", 1, "train"), ("", 1, "train")], "source string, n bigint, split string")
    monkeypatch.setattr(catalogue, "group_split", lambda spark, d: wrong)
    assert found() == {"test": (6, 1, 1), "train": (10, 3, 1), None: (2, 1, 1)}


# Sources and sinks


def test_catalog_scan(spark, tmp_path):
    (tmp_path / "alpha.src.txt").write_text("CCN A-1\n>>>CC(=O)O A-2 extra\n\nCCN A-3\nnot_a_smiles A-4\n")
    scan = readers.with_ordinal(readers.catalogs(spark, str(tmp_path)))
    rows = {r["line_no"]: r for r in scan.collect()}
    assert len(rows) == 5 and not rows[3]["well_formed"] and rows[2]["structure"] == "CC(=O)O" and rows[2]["supplied"] == ">>>CC(=O)O" and rows[4]["ordinal"] == 4
    good, failed, malformed = standardize.routed(standardize.standardised(scan, "structure"))
    kept = good.select("line_no", "std.dedup_key")
    mapping = dedup.duplicate_mapping(kept, "dedup_key", "line_no", ["line_no"])
    assert (malformed.count(), failed.first()["failure_stage"], mapping.count(), kept.select("dedup_key").distinct().count()) == (1, "smiles_parse", 1, 2)


def test_mapping_and_tables(spark, tmp_path):
    with gzip.open(tmp_path / "alpha.info.txt.gz", "wt") as f:
        f.write("A-1\tZINC1\tK1\nA-1\tZINC1\tK1\n\tZINC2\tK2\nA-3\tX9\tK3\nA-4\tZINC4\n")
    assert [tuple(r) for r in readers.mappings(spark, str(tmp_path / "*.gz"), "ZINC").collect()] == [("alpha", "A-1", "ZINC1", "K1")]
    (tmp_path / "in.csv").write_text("﻿id,smiles\n1,CC\n2,\n")
    df, a, b = readers.inferred_table(spark, str(tmp_path / "in.csv"))
    assert (a, b, df.count()) == ("id", "smiles", 2)
    with pytest.raises(ValueError, match="missing columns: x"):
        readers.strings_table(spark, str(tmp_path / "in.csv"), ["x"], sep=",")
    (tmp_path / "tree.tsv").write_text("parent_class_id\tchild_class_id\n0.0\t1\n1.0\t2\n")
    assert [tuple(r) for r in readers.tree_edges(spark, str(tmp_path / "tree.tsv")).collect()] == [(0, 1), (1, 2)]


def test_graph_files_round_trip(spark, tmp_path):
    nodes, edges = demo.PARTS.node_frame(spark), demo.PARTS.edge_frame(spark)
    (tmp_path / "g.graphml").write_text(sinks.graphml_text(nodes, edges))
    n, e = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert quality.difference(n, nodes.select("class_id")).count() == 0 and quality.difference(e, edges).count() == 0
    text = sinks.graph_json(nodes, edges, {"version": "1"})
    assert text.endswith("\n") and len(json.loads(text)["edges"]) == len(demo.EDGES)


def test_sinks_refuse_and_version(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id bigint, x array<string>")
    sinks.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_table(df, str(tmp_path / "t"))
    assert sinks.write_version(df, str(tmp_path / "v"), "1") != sinks.write_version(df, str(tmp_path / "v"), "2")
    sinks.write_tsv(df, str(tmp_path / "tsv"))
    assert readers.strings_table(spark, str(tmp_path / "tsv")).first()["x"] == "a;b"
    assert "| id | x |" in sinks.markdown(df, "T") and readers.largest_file(spark, str(tmp_path / "t"))


# Responses and streams


def test_outcomes(spark):
    cases = [(200, "", "EMPTY"), (200, "{}", "EMPTY"), (200, "[]", "EMPTY"), (200, "null", "EMPTY"), (200, "<html>", "NONJSON"), (200, '{"class":{"name":"x"}}', "HIT"), (200, '{"a":1}', "NOLABEL"), (200, '{"class":null}', "NOLABEL"), (404, None, "MISS"), (500, None, "SERVER5XX"), (429, None, "THROTTLED"), (418, None, "HTTP418"), (None, None, "NO_ANSWER")]
    df = spark.createDataFrame([(s, b, w) for s, b, w in cases], "s int, b string, want string")
    assert df.withColumn("got", incremental.outcome(F.col("s"), F.col("b"))).filter("got <> want").collect() == []


def test_acquisition_resumes_without_repeats(spark, tmp_path):
    cols = "inchikey string, http_status int, raw_json string, fetched_at string"
    (tmp_path / "in").mkdir()
    put = lambda rows: spark.createDataFrame(rows, cols).write.mode("append").json(str(tmp_path / "in"))
    run = lambda: incremental.acquire(spark, spark.readStream.schema(cols).json(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "cp")).awaitTermination()
    put([("a", 200, '{"class":{"name":"x"}}', "1"), ("b", 429, None, "1")])
    run()
    put([("a", 404, None, "2"), ("b", 404, None, "2")])
    run()
    run()
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert {(r["inchikey"], r["outcome"]) for r in cache.collect()} == {("a", "HIT"), ("b", "MISS")} and cache.count() == 2
    keys = spark.createDataFrame([("a",), ("c",)], "inchikey string")
    assert [r[0] for r in incremental.pending(keys, cache, "inchikey").collect()] == ["c"]


def test_breaker_and_windows(spark):
    df = spark.createDataFrame([("h", i, i % 4 != 0) for i in range(12)], "host string, at int, bad boolean")
    runs = [r["run"] for r in incremental.breaker(df, "host", "at", F.col("bad"), trip=3).orderBy("at").collect()]
    assert runs == [0, 1, 2, 3] * 3
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, event_type string")
    assert sorted(r["n"] for r in incremental.windowed_counts(events).collect()) == [1, 2]
    assert incremental.passes(iter([5, 3, 3]).__next__) == 3


def test_documents_and_databases(spark, tmp_path):
    import sqlite3

    (tmp_path / "a.json").write_text(json.dumps({"name": "x", "rows": [{"a": 1}, {"a": 2}], "tags": ["p", "q"]}, indent=1))
    assert readers.json_document(spark, str(tmp_path / "a.json")).first()["name"] == "x"
    assert sorted(r[0] for r in readers.json_document(spark, str(tmp_path / "a.json"), "rows").collect()) == [1, 2] and readers.json_document(spark, str(tmp_path / "a.json"), "tags").count() == 2
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE t (k text, n int)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [("a", 1), ("b", None)])
    con.commit()
    con.close()
    assert {tuple(r) for r in readers.sqlite_table(spark, str(tmp_path / "a.db"), "SELECT k, n FROM t", "k string, n int").collect()} == {("a", 1), ("b", None)}
    (tmp_path / "t.tsv").write_text("id\tsmiles\n1\tC\n2\tCC\n")
    assert {r["scan_was_bounded"] for r in readers.inferred_table(spark, str(tmp_path / "t.tsv"), max_rows=1)[0].collect()} == {True}
    assert {r["scan_was_bounded"] for r in readers.inferred_table(spark, str(tmp_path / "t.tsv"), max_rows=2)[0].collect()} == {False}


def test_graph_files_keep_odd_ids(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", "<x>"), ('q"\'', None)], "class_id string, name string")
    edges = spark.createDataFrame([("a & b", 'q"\'')], "parent_id string, child_id string")
    (tmp_path / "g.graphml").write_text(sinks.graphml_text(nodes, edges))
    back = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r[0] for r in back[0].collect()} == {"a & b", 'q"\''} and [tuple(r) for r in back[1].collect()] == [("a & b", 'q"\'')]


def test_sentinels_and_audit(spark, tmp_path):
    row = spark.createDataFrame([(3, "target_reached")], "n_hits int, reason string")
    where = str(tmp_path / "done")
    assert not sinks.is_done(spark, where) and sinks.mark_done(row, where) and sinks.is_done(spark, where) and not sinks.mark_done(row, where)
    for _ in range(2):
        sinks.append_audit(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_edge_cases_of_evaluation(spark):
    facts = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "item int, class_id string")
    assert enrich.without(facts, "class_id", ["a"]).count() == 2 and enrich.without(facts, "class_id", spark.createDataFrame([("b",)], "class_id string")).count() == 2
    rows = spark.createDataFrame([(1, ["x", "y", "x"]), (2, []), (3, None)], "k int, ids array<string>")
    assert as_map(enrich.flag_unknown(rows, "k", "ids", spark.createDataFrame([("x",)], "id string"), "id"), "k", "unknown_ids") == {1: ["y"], 2: [], 3: []}
    counts = spark.createDataFrame([(80, 149), (0, 5), (0, 0)], "h int, n int")
    found = [tuple(r) for r in counts.select(*evaluate.required_lookups(F.col("h"), F.col("n"), 18000, 1500).values()).collect()]
    assert found == [(round(80 / 149 * 18000, 6), 2794, round(1500 / 18000, 6)), (0.0, None, round(1500 / 18000, 6)), (None, None, round(1500 / 18000, 6))]
    nobody = spark.createDataFrame([], "k string, outcome string")
    state = incremental.stop_state(spark.createDataFrame([("a",)], "k string"), nobody, "k", 1).first()
    assert (state["n_hits"], state["n_pending"], state["reason"]) == (0, 1, None)


@pytest.mark.parametrize("kind", ["many", "few", "none"])
def test_matches_of_one_key_are_dealt_to_many_tasks(spark, monkeypatch, kind):
    monkeypatch.setattr(enrich, "BLOCK_ROWS", 8, raising=False)
    left = [("hot", i) for i in range(90 if kind == "many" else 5)] + [(f"k{i % 7}", i) for i in range(20)] + [(None, 1), ("alone", 2), ("hot", 0)]
    right = [] if kind == "none" else [("hot", f"r{i}") for i in range(70 if kind == "many" else 2)] + [(f"k{i % 5}", "x") for i in range(9)] + [(None, "n"), ("other", "o"), ("hot", "r0")]
    a, b = spark.createDataFrame(left, "k string, i int").coalesce(1), spark.createDataFrame(right, "k string, name string").coalesce(1)
    got = enrich.all_matches(a, b, ["k"])
    assert got.columns == ["k", "i", "name"]
    wanted = [(k, i, n) for k, i in left for n in ([n for x, n in right if x == k and k is not None] or [None])]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(wanted)
    if kind == "many":
        largest = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert largest < len(wanted) / 4


def test_probes_gather_no_facts(spark, monkeypatch):
    monkeypatch.setattr(quality, "PROBES", 4, raising=False)
    facts = [(i, c) for i in range(20) for c in ("a", "b") if i % 3] * 2 + [(None, "a")]
    asked = [(i, c, bool(i % 2)) for i in range(22) for c in ("a", "c")] + [(4, "a", False), (None, "a", True), (1, "a", None)]
    kind = "item_id int, class_id string"
    got = quality.probes(spark.createDataFrame(facts, kind), spark.createDataFrame(asked, f"{kind}, wanted boolean"))
    known = {f for f in facts if f[0] is not None}
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(a for a in asked if a[2] is not None and a[2] != (a[:2] in known))
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
