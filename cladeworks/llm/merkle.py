"""Merkle manifest of a table: a tree of SHA-256 digests for each language, and one over the languages.

Leaves are numbered within their tree by a range partitioning. An aligned block of FANOUT**DEPTH leaves is one
contiguous matrix of 64-byte hexadecimal digests in one task: a level is the matrix read in rows of FANOUT
digests, and a leaf's run and siblings on every level follow from its number alone. A block leaves one
digest, so the blocks' digests make the next table of leaves until one is left a tree. The way down takes
each block's siblings from the block above it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .runtime import arrow_session, pinned, stored, text_buffers

#: Digests hashed together.
FANOUT = 8
#: Levels of a block: 4,096 leaves.
DEPTH = 4
BLOCK = FANOUT**DEPTH
#: What a leaf says, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 length, a colon and itself; a null is a hyphen."""
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.encode(F.concat(*said), "UTF-8"), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, tree, leaf and tampered: the digest after A-Z of the text were lower-cased, in the third of the rows whose CRC says so, else null.

    ``tree`` is the language behind an equals sign, or empty for a null, so that it sorts as languages do.
    """
    as_text = {c: F.col(c).cast("bigint").cast("string") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in fields}
    changed = as_text | {"text": F.translate(as_text["text"], UPPER, LOWER)}
    chosen = F.crc32(F.encode(as_text["doc_id"], "UTF-8")) % 3 == 0
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("="), as_text["lang"]), F.lit("")).alias("tree"),
        leaf_digest([as_text[c] for c in fields]).alias("leaf"), F.when(chosen, leaf_digest([changed[c] for c in fields])).alias("tampered"),
    )


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds place, from 0 within ``tree`` in ``order``, and total, the tree's rows.

    Rows are dealt by range and counted by partition; only these counts reach the driver. A tree's first
    row and size are joined back, however many rows it has.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = pinned(df.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order))
    id_ = F.monotonically_increasing_id()
    starts, before = [], 0
    for part, n in sorted((r[0], r[1]) for r in run.groupBy(F.spark_partition_id()).count().collect()):
        starts.append((part, before))
        before += n
    at = spark.createDataFrame(starts, "part int, before bigint")
    ranked = run.withColumns({"part": F.shiftright(id_, 33).cast("int"), "own": id_.bitwiseAND(F.lit((1 << 33) - 1))}).join(F.broadcast(at), "part")
    ranked = ranked.select(*df.columns, (F.col("before") + F.col("own")).alias("rank"))
    trees = ranked.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("total"))
    return ranked.join(trees, "tree").select(*df.columns, (F.col("rank") - F.col("first")).alias("place"), "total")


def levels(total: int) -> int:
    """Levels that a block of a tree of so many nodes has: until one is left, DEPTH at most."""
    return next((k for k in range(DEPTH) if FANOUT**k >= total), DEPTH)


def digests(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hexadecimal SHA-256 of consecutive spans of a byte vector, as a matrix of 64 bytes a row."""
    view = memoryview(np.ascontiguousarray(flat))
    out = "".join([sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    return np.frombuffer(out.encode(), np.uint8).reshape(-1, WIDTH)


def block_levels(matrix: np.ndarray, total: int) -> list[np.ndarray]:
    """The digest matrices of a block, from its leaves to its root: rows of FANOUT digests are hashed level by level; a last row may be shorter."""
    out = [matrix]
    for _ in range(levels(total)):
        n = len(out[-1])
        bounds = np.minimum(np.arange(0, n + FANOUT, FANOUT), n)[: -(-n // FANOUT) + 1] * WIDTH
        out.append(digests(out[-1].ravel(), bounds))
    return out


def in_order(part: pa.Table, column: str) -> tuple[pa.Table, np.ndarray]:
    """A group's rows by place, and a column of digests as one matrix."""
    part = part.take(np.argsort(part.column("place").to_numpy(), kind="stable"))
    return part, text_buffers(part.column(column))[0].reshape(-1, WIDTH)


#: For each position of a run, the others.
OTHERS = np.array([[k for k in range(FANOUT) if k != p] for p in range(FANOUT)])


def block_proofs(above: list[np.ndarray], tail: bytes) -> tuple[np.ndarray, list[bytes]]:
    """For each leaf of a block: SHA-256 of all its siblings, and the siblings themselves, level by level, ``tail`` last."""
    n = len(above[0])
    rows, there = [np.zeros((n, 0, WIDTH), np.uint8)], [np.zeros((n, 0), bool)]
    for k, matrix in enumerate(above[:-1]):
        run, turn = np.divmod(np.arange(n) // FANOUT**k, FANOUT)
        sibling = run[:, None] * FANOUT + OTHERS[turn]
        there.append(sibling < len(matrix))
        rows.append(matrix[np.minimum(sibling, len(matrix) - 1)])
    there = np.concatenate(there, 1)
    packed = np.concatenate(rows, 1)[there].tobytes()
    bounds = np.concatenate([[0], np.cumsum(there.sum(1))]) * WIDTH
    proofs = [packed[a:b] + tail for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    hashed = np.frombuffer("".join([sha256(p).hexdigest() for p in proofs]).encode(), np.uint8).reshape(-1, WIDTH)
    return hashed, proofs


def folded(above: list[np.ndarray], now: np.ndarray, path: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Roots that follow from the leaves ``now`` and the siblings that the block's own leaves have."""
    n = len(now)
    for k, matrix in enumerate(above[:-1]):
        run, turn = np.divmod(np.arange(n) // FANOUT**k, FANOUT)
        member = run[:, None] * FANOUT + np.arange(FANOUT)
        there = member < len(matrix)
        rows = matrix[np.minimum(member, len(matrix) - 1)]
        rows[np.arange(n), turn] = now
        now = digests(rows[there].ravel(), np.concatenate([[0], np.cumsum(there.sum(1))]) * WIDTH)
    for left, right in path:
        kinds, code = np.unique(now.view(f"S{WIDTH}").ravel(), return_inverse=True)
        out = "".join([sha256(left + node + right).hexdigest() for node in kinds.tolist()])
        now = np.frombuffer(out.encode(), np.uint8).reshape(-1, WIDTH)[code]
    return np.ascontiguousarray(now)


NODES = "tree string, place bigint, total bigint, digest string"
PATHS = "tree string, place bigint, path array<struct<left:string,right:string>>, subroot string, root string"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def block_of(place: str = "place") -> Column:
    return F.floor(F.col(place) / BLOCK).cast("bigint")


def climb(nodes: DataFrame) -> DataFrame:
    """One node for each block of ``nodes`` (NODES), numbered as the blocks are."""

    def up(key: tuple, part: pa.Table) -> pa.Table:
        part, matrix = in_order(part, "digest")
        total = part.column("total")[0].as_py()
        top = block_levels(matrix, total)[-1]
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "total": [-(-total // BLOCK)], "digest": [top.tobytes().decode()]})

    return nodes.select("tree", "place", "total", "digest", block_of().alias("block")).groupBy("tree", "block").applyInArrow(up, NODES)


def paths_below(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """PATHS of ``nodes`` from those of their blocks: what stands left and right of each node on all levels up to the root."""

    def down(part: pa.Table, over: pa.Table) -> pa.Table:
        part, matrix = in_order(part, "digest")
        matrices = block_levels(matrix, part.column("total")[0].as_py())
        rest = over.column("path")[0].as_py()
        text = [m.tobytes().decode() for m in matrices]
        out = []
        for i in range(len(matrix)):
            own = []
            for k, (m, t) in enumerate(zip(matrices[:-1], text[:-1], strict=True)):
                at = i // FANOUT**k
                run = at - at % FANOUT
                own.append({"left": t[run * WIDTH : at * WIDTH], "right": t[(at + 1) * WIDTH : min(run + FANOUT, len(m)) * WIDTH]})
            out.append(own + rest)
        same = {c: pa.array([over.column(c)[0].as_py()] * len(out), pa.string()) for c in ("subroot", "root")}
        return pa.table({"tree": part.column("tree"), "place": part.column("place"), "path": pa.array(out, pa.list_(STEP))} | same)

    left = nodes.select("tree", "place", "total", "digest", block_of().alias("block")).groupBy("tree", "block")
    return left.cogroup(above.select("*", F.col("place").alias("block")).groupBy("tree", "block")).applyInArrow(down, PATHS)


def tree_levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tables of block digests above them, up to one node a tree, each written to the shared folder."""
    out = [nodes]
    while True:
        out.append(stored(climb(out[-1])))
        if (out[-1].agg(F.max("total")).first()[0] or 1) == 1:
            return out


def with_proofs(rows: DataFrame, siblings: bool = False) -> DataFrame:
    """Of ``leaves``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified; with ``siblings`` also the proof, all sibling digests end to end.

    Leaves ascend by doc_id (null first) and then by digest, so repeated rows have a defined order. A tree of
    one leaf has it as its subroot, one of one language has its subroot as root; an empty table gives an
    empty result. Runs of one node have no sibling, and are hashed all the same.
    """
    arrow_session(rows.sparkSession)
    base = stored(numbered(stored(rows), ["doc_id", "leaf"]))
    own = tree_levels(base.select("tree", "place", "total", F.col("leaf").alias("digest")))
    subroots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = tree_levels(stored(numbered(subroots, ["name"])).select("tree", "place", "total", "digest", "name"))
    root = top[-1].select("tree", "place", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = root
    for nodes in reversed(top[:-1]):
        paths = stored(paths_below(nodes, paths))
    named = top[0].select("place", "name", "digest").join(paths.select("place", "path", "root"), "place")
    paths = named.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("place"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(own[1:-1]):
        paths = stored(paths_below(nodes, paths))
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * siblings

    def prove(part: pa.Table, over: pa.Table) -> pa.Table:
        part, matrix = in_order(part, "leaf")
        above = block_levels(matrix, part.column("total")[0].as_py())
        path = [(s["left"].encode(), s["right"].encode()) for s in over.column("path")[0].as_py()]
        hashed, proofs = block_proofs(above, b"".join(a + b for a, b in path))
        now = matrix.copy()
        held = part.column("tampered")
        marked = np.flatnonzero(held.is_valid().to_numpy())
        now[marked] = text_buffers(held.drop_null())[0].reshape(-1, WIDTH)
        top_ = folded(above, now, path)
        root_ = over.column("root")[0].as_py()
        text = lambda m: pa.array([s.decode() for s in np.ascontiguousarray(m).view(f"S{WIDTH}").ravel().tolist()], pa.string())
        out = {"doc_id": part.column("doc_id"), "leaf": part.column("leaf")}
        out |= {c: pa.array([over.column(c)[0].as_py()] * len(matrix), pa.string()) for c in ("subroot", "root")}
        ends = text(top_)
        out |= {"proof_sha256": text(hashed), "folded_root": ends, "verified": pa.array([e == root_ for e in ends.to_pylist()])}
        return pa.table(out | ({"proof": pa.array([p.decode() for p in proofs])} if siblings else {}))

    left = base.select("*", block_of().alias("block")).groupBy("tree", "block")
    return left.cogroup(paths.select("*", F.col("place").alias("block")).groupBy("tree", "block")).applyInArrow(prove, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's leaf, its language's subroot, the table's root, its proof, and the root that follows after the chosen rows' texts were lower-cased.

    Any column may be null; a row whose doc_id is null is never tampered with. Columns other than FIELDS are
    not read. A text of any length is hashed where it is read and goes no further.
    """
    return with_proofs(leaves(docs))


# The same in SQL: a CTE a level.


def oracle_sql(depth: int = 9) -> str:
    """Trees of up to FANOUT**depth leaves, and as many languages' subroots as three levels hold."""
    value = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    said = lambda text: " || ".join(value(f"{c}::varchar") if c in ("doc_id", "n_chars") else value(text if c == "text" else c) for c in FIELDS)
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        # CRC-32 of the decimal id, bit by bit over its bytes.
        "ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)",
        "crc(doc_id, i, b, c) AS (SELECT doc_id, 0, 8, 4294967295::ubigint FROM ids UNION ALL SELECT doc_id, CASE WHEN b = 8 THEN i + 1 ELSE i END, CASE WHEN b = 8 THEN 0 ELSE b + 1 END, CASE WHEN b = 8 THEN xor(c, ascii(substr(doc_id::varchar, i + 1, 1))::ubigint) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END FROM crc WHERE b < 8 OR i < length(doc_id::varchar))",
        "chosen AS (SELECT doc_id FROM crc WHERE b = 8 AND i = length(doc_id::varchar) AND xor(c, 4294967295::ubigint) % 3 = 0)",
        f"leaf AS (SELECT doc_id, lang, sha256({said('text')}) AS leaf, sha256({said(lower)}) AS lowered FROM documents)",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf)",
        "n0 AS (SELECT lang, i, n, leaf AS d FROM l0)",
    ]

    def grow(name: str, by: str, most: int) -> None:
        for k in range(most):
            ctes.append(f"{name}{k + 1} AS (SELECT {by}, i // {FANOUT} AS i, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY {by}, i // {FANOUT} UNION ALL SELECT {by}, 0, 1, d FROM {name}{k} WHERE n = 1)")
            beside = lambda where: f"coalesce(string_agg(d, '') OVER (PARTITION BY {by}, i // {FANOUT} ORDER BY i ROWS BETWEEN {where}), '')"
            ctes.append(f"{name}s{k} AS (SELECT {by}, i, n > 1 AS up, CASE WHEN n > 1 THEN {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} ELSE '' END AS a, CASE WHEN n > 1 THEN {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} ELSE '' END AS z FROM {name}{k})")

    grow("n", "lang", depth)
    ctes.append(f"m0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, lang FROM n{depth})")
    grow("m", "one", 3)
    ctes.append(f"f0 AS (SELECT l0.doc_id, l0.lang, l0.i AS at, l0.i, leaf, CASE WHEN c.doc_id IS NULL THEN leaf ELSE lowered END AS now, '' AS proof, row_number() OVER () AS r FROM l0 LEFT JOIN chosen c ON l0.doc_id = c.doc_id)")
    step = 0
    for k in range(depth):
        ctes.append(f"f{step + 1} AS (SELECT f.* REPLACE (f.i // {FANOUT} AS i, CASE WHEN up THEN sha256(a || now || z) ELSE now END AS now, proof || a || z AS proof) FROM f{step} f JOIN ns{k} s ON f.lang IS NOT DISTINCT FROM s.lang AND f.i = s.i)")
        step += 1
    ctes.append(f"g0 AS (SELECT f.* REPLACE (m.i AS i), m.d AS subroot FROM f{step} f JOIN m0 m ON f.lang IS NOT DISTINCT FROM m.lang)")
    for k in range(3):
        ctes.append(f"g{k + 1} AS (SELECT f.* REPLACE (f.i // {FANOUT} AS i, CASE WHEN up THEN sha256(a || now || z) ELSE now END AS now, proof || a || z AS proof) FROM g{k} f JOIN ms{k} s ON f.i = s.i)")
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, leaf, subroot, m3.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = m3.d AS verified FROM g3, m3"
