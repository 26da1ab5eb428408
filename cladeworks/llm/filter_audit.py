"""How filters act together: what each removes, at each place of every order, by part of the corpus.

A document's verdicts are one mask of five bits, and everything asked for is a sum over counts by mask. The
one filter that looks at other documents, duplicates, is found by partition refinement: classes of
equal length are split by hashes of successive blocks of the text, classes of one document are dropped,
and the whole texts that are left are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .runtime import arrow_session, stored

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Least words; percent of distinct words at least; percent of capitals at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points of the first block; each further one ends at GROWTH times as many.
FIRST_BLOCK, GROWTH = 256, 8
#: Bits of the filter that tells a scan which texts may be in a class: one megabyte, whatever the data.
FILTER_BITS = 1 << 23
BITMAP_BITS = 1 << 15


def own_failures(text: Column) -> Column:
    """The bits of filters A to D, from the text alone."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("kinds")))[0]
    points = F.char_length(text).cast("bigint")
    capitals = points - F.char_length(F.translate(text, CAPITALS, ""))
    symbol = F.char_length(F.translate(text, "#$%&*|", "")) < points
    bit = lambda test, k: F.when(test, 1 << k).otherwise(0)
    verdict = lambda c: bit(c["n"] < LEAST_WORDS, 0) + bit(100 * c["kinds"] < LEAST_DISTINCT * c["n"], 1)
    return F.transform(F.array(counts), verdict)[0] + bit(100 * capitals > MOST_CAPITALS * points, 2) + bit(symbol, 3)


def block_ends(most: int) -> list[int]:
    """Code points at which the blocks of a text of ``most`` end."""
    out = [FIRST_BLOCK]
    while out[-1] < most:
        out.append(out[-1] * GROWTH)
    return out


def refined(rows: DataFrame, most: int) -> DataFrame:
    """(length, digest, least): the classes of two rows or more that agree in length and in the hashes of all blocks; least is the smallest doc_id.

    ``rows`` has doc_id, length and blocks, the hashes of the blocks that the text has. A round splits the
    classes by one more block. Only counts by class are joined back, and rows whose text has no further
    block leave the rounds.
    """
    done, left = [], rows.withColumn("digest", F.lit(0).cast("bigint"))
    for k in range(len(block_ends(most)) + 1):
        if k:
            left = left.withColumn("digest", F.xxhash64("digest", F.col("blocks")[k - 1]))
        classes = left.groupBy("length", "digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1").drop("n")
        classes = stored(classes)
        over = F.col("length") <= (0 if k == 0 else block_ends(most)[k - 1])
        done.append(classes.filter(over))
        left = stored(left.join(classes.filter(~over).drop("least"), ["length", "digest"]))
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def class_filter(classes: DataFrame) -> DataFrame:
    """A bitmap of the classes' hashes in 256 rows of four kilobytes: a bounded table that any scan may broadcast."""
    at = F.pmod(F.xxhash64("length", "digest"), F.lit(FILTER_BITS))
    return classes.groupBy(F.floor(at / BITMAP_BITS).alias("strip")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BITMAP_BITS))).alias("bits"))


def maybe_in(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (with length and digest) that may be in a class; the rest is left out before anything is shuffled."""
    at = F.pmod(F.xxhash64("length", "digest"), F.lit(FILTER_BITS))
    place = F.pmod(at, F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    marked = rows.withColumn("strip", F.floor(at / BITMAP_BITS)).join(F.broadcast(class_filter(classes)), "strip")
    return marked.filter(held).drop("strip", "bits")


def hashes(text: Column, most: int, of: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Hashes of the blocks that a text has."""
    ends = block_ends(most)
    starts = [0, *ends[:-1]]
    return F.filter(F.array(*[F.when(F.char_length(text) > a, of(F.substring(text, a + 1, b - a))) for a, b in zip(starts, ends, strict=True)]), lambda h: h.isNotNull())


def masks(docs: DataFrame, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, part and mask: bit k is set where filter k of LETTERS fails.

    A null text is empty and a null source is the part ''. A row fails E if its text stands under a smaller
    doc_id; rows of one doc_id do not fail each other, and a null doc_id neither fails nor makes others fail.
    Texts are read twice and moved only where their length and the hashes of all their blocks recur; of
    equal ones each task moves one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("length", F.char_length("text").cast("bigint"))
    most = base.agg(F.max("length")).first()[0] or 0
    base = base.withColumn("blocks", hashes(F.col("text"), most, block_hash))
    rows = stored(base.select("doc_id", "part", "length", "blocks", own_failures(F.col("text")).alias("mask")))
    classes = stored(refined(rows.select("doc_id", "length", "blocks"), most))
    digest = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, h: F.xxhash64(a, h))
    keyed = rows.withColumn("digest", digest)
    # Whole texts: one row for each text of a class. Where a class has one text, its rows are that text.
    texts = maybe_in(base.withColumn("digest", digest), classes).join(classes.select("length", "digest"), ["length", "digest"], "left_semi")
    texts = stored(texts.groupBy("length", "digest", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    kinds = texts.groupBy("length", "digest").agg(F.count("*").alias("kinds"), F.min("least").alias("least"))
    alike = F.col("doc_id") > F.col("least")
    single = keyed.join(kinds.filter("kinds = 1").drop("kinds"), ["length", "digest"], "left").withColumn("copy", F.coalesce(alike, F.lit(False)))
    out = single.select("doc_id", "part", (F.col("mask") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))
    clashes = kinds.filter("kinds > 1").drop("kinds", "least")
    if clashes.isEmpty():
        return out
    # Texts whose hashes agree though they differ: their documents are judged by the texts themselves.
    at_odds = texts.join(clashes, ["length", "digest"], "left_semi").select("length", "digest", "text", "least")
    judged = base.withColumn("digest", digest).join(at_odds, ["length", "digest", "text"])
    judged = judged.select("doc_id", "part", (own_failures(F.col("text")) + F.when(alike, 16).otherwise(0)).alias("mask"))
    clear = single.join(clashes, ["length", "digest"], "left_anti").select("doc_id", "part", (F.col("mask") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))
    return clear.unionByName(judged)


def mask_counts(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those with quality 1 and toxic 1. A doc_id that labels has more than once counts as labelled so if any row says so."""
    said = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    add = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return verdicts.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), add("good"), add("toxic"))


def selections() -> dict[str, np.ndarray]:
    """For each count, a matrix of masks by (order, step): 1 where a document of that mask counts."""
    bits = (np.arange(32)[:, None] >> np.arange(5)) & 1  # mask x filter
    out = {k: np.zeros((32, len(ORDERS) * 5), np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    for i, order in enumerate(ORDERS):
        before = np.zeros(32, np.int64)
        for step, letter in enumerate(order):
            own, at = bits[:, LETTERS.index(letter)], i * 5 + step
            out["removed"][:, at] = own & ~before
            out["redundant"][:, at] = own & before
            out["unique_fails"][:, at] = own & (bits.sum(1) == 1)
            before = before | own
            out["kept"][:, at] = 1 - before
    return out


AUDIT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit(counts: DataFrame) -> DataFrame:
    """AUDIT, zeros included: 600 rows for each part of ``mask_counts``. A part has 32 masks at most, so all its counts are one row."""
    shared = selections()
    wide = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = np.array([LETTERS.index(x) for order in ORDERS for x in order])
        steps = len(letter)
        for frame in frames:
            for part, held in zip(frame["part"], frame["held"], strict=True):
                n, good, toxic = np.zeros((3, 32), np.int64)
                for h in held:
                    n[h["mask"]], good[h["mask"]], toxic[h["mask"]] = h["n"], h["good"], h["toxic"]
                found = {k: n @ m for k, m in shared.items()} | {"good_lost": good @ shared["removed"], "toxic_lost": toxic @ shared["removed"]}
                found["shapley"] = np.bincount(letter, found["removed"], len(LETTERS)).astype(np.int64)[letter]
                yield pd.DataFrame({"part": part, "filter_order": np.repeat(ORDERS, len(LETTERS)), "step": np.tile(np.arange(1, 6), steps // 5)} | found)

    return wide.mapInPandas(expand, AUDIT)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT of all documents by their source. An empty table gives an empty result; columns besides doc_id, source and text are not read."""
    arrow_session(docs.sparkSession)
    return audit(stored(mask_counts(masks(docs), labels)))


def oracle_sql() -> str:
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    orders = " UNION ALL ".join(f"SELECT '{o}' AS filter_order" for o in ORDERS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, [len(w) < {LEAST_WORDS}, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w), 100 * (length(t) - length(translate(t, '{CAPITALS}', ''))) > {MOST_CAPITALS} * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
parts AS (SELECT DISTINCT part FROM d),
orders AS ({orders}),
places AS (SELECT filter_order, step, list_transform(range(1, step), lambda k: instr('{LETTERS}', substr(filter_order, k::int, 1))) AS earlier, instr('{LETTERS}', substr(filter_order, step::int, 1)) AS own FROM orders, range(1, 6) AS r(step)),
c AS (SELECT part, filter_order, step, n, good, bad, fails[own] AS failing, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails FROM m, places),
s AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::bigint AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::bigint AS removed, coalesce(sum(n) FILTER (gone AND failing), 0)::bigint AS redundant,
  coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::bigint AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND failing), 0)::bigint AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND failing), 0)::bigint AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step::int, 1)))::bigint AS shapley FROM s"""
