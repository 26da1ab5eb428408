"""A rule set over the part table, for queries and tests: two nodes have two parents, as real class graphs do."""

from __future__ import annotations

from ..operators.rules import ClassNode, Rule, RuleSet

NODES = (
    ("0001", "Item", 0), ("0100", "Typed item", 10), ("0110", "Economy line", 40), ("0120", "Promotional line", 40), ("0130", "Standard line", 40), ("0200", "Small item", 50),
    ("0210", "Tiny item", 70), ("0220", "Large item", 50), ("0310", "Red item", 60), ("0320", "Blue item", 60), ("0410", "Ring", 80), ("0420", "Bolt", 80), ("0430", "Gear", 80),
    ("0500", "Premium item", 55), ("0600", "Red ring", 100), ("0610", "Blue bolt", 100), ("0700", "Multiple", 5), ("0800", "Unresolved", -100),
)
EDGES = (
    ("0001", "0100"), ("0100", "0110"), ("0100", "0120"), ("0100", "0130"), ("0100", "0200"), ("0200", "0210"), ("0100", "0220"), ("0100", "0310"), ("0100", "0320"), ("0100", "0410"),
    ("0100", "0420"), ("0100", "0430"), ("0100", "0500"), ("0310", "0600"), ("0410", "0600"), ("0320", "0610"), ("0420", "0610"), ("0100", "0700"), ("0100", "0800"),
)
RULES = (
    ("0100", "p_type IS NOT NULL", None, False), ("0110", "p_type = 'ECONOMY'", "line", True), ("0120", "p_type = 'PROMO'", "line", True), ("0130", "p_type = 'STANDARD'", "line", True),
    ("0200", "p_size <= 15", "size", True), ("0210", "p_size <= 5", "size", True), ("0220", "p_size >= 45", "size", True), ("0310", "p_name LIKE 'red %'", "colour", True),
    ("0320", "p_name LIKE 'blue %'", "colour", True), ("0410", "p_name LIKE '% ring'", "shape", True), ("0420", "p_name LIKE '% bolt'", "shape", True), ("0430", "p_name LIKE '% gear'", "shape", True),
    ("0500", "p_retailprice >= 990", "price", True), ("0600", "p_name = 'red ring'", "shape", True), ("0610", "p_name = 'blue bolt'", "shape", True),
)

PARTS = RuleSet(tuple(ClassNode(*n) for n in NODES), EDGES, tuple(Rule(*r) for r in RULES), root="0001", gate="p_type <> 'MEDIUM'", multiple="0700", unresolved="0800")

EDGE_VALUES = ", ".join(f"('{p}', '{c}')" for p, c in EDGES)
NODE_VALUES = ", ".join(f"('{i}', '{n}', {p})" for i, n, p in NODES)
#: SQL for the direct classes of all parts, for DuckDB.
DIRECT_SQL = (
    "hits AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS class_id FROM part WHERE p_type <> 'MEDIUM' AND {e}" for c, e, _, _ in RULES) + "), "
    + "families AS (SELECT p_partkey, count(DISTINCT f) AS n FROM (" + " UNION ALL ".join(f"SELECT p_partkey, '{f}' AS f FROM part WHERE p_type <> 'MEDIUM' AND {e}" for _, e, f, _ in RULES if f) + ") GROUP BY p_partkey), "
    + "resolved AS (SELECT DISTINCT p_partkey FROM hits WHERE class_id IN (" + ", ".join(f"'{c}'" for c, _, _, s in RULES if s) + ")), "
    + "direct AS (SELECT * FROM hits UNION ALL SELECT p_partkey, '0700' FROM families WHERE n >= 2 "
    "UNION ALL SELECT p_partkey, '0800' FROM part WHERE p_type <> 'MEDIUM' AND p_partkey NOT IN (SELECT p_partkey FROM resolved) "
    "UNION ALL SELECT p_partkey, '0001' FROM part WHERE p_type = 'MEDIUM' OR p_type IS NULL)"
)
GRAPH_SQL = (
    f"edges(parent_id, child_id) AS (VALUES {EDGE_VALUES}), nodes(class_id, name, priority) AS (VALUES {NODE_VALUES}), "
    "walk(node, path) AS (SELECT '0001', ['0001'] UNION ALL SELECT e.child_id, list_append(w.path, e.child_id) FROM walk w JOIN edges e ON e.parent_id = w.node), "
    "best AS (SELECT node, max(len(path)) - 1 AS depth, arg_max(path, {n: len(path), p: path}) AS path FROM walk GROUP BY node), "
    "pairs AS (SELECT DISTINCT a AS ancestor, node FROM walk, unnest(path) AS t(a) WHERE a <> node)"
)
