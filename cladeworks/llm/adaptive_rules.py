"""Quality rules whose cutoffs follow each language's and source's own texts, in DataFrame functions only.

A metric's distribution is kept as a histogram over integer buckets: exact below 64, then 32 buckets a
doubling, so a quantile is off by at most a thirty-second. Histograms of parts add up to the whole's,
which is how a group's sketch is made, merged into its language's, and merged into the corpus's. A
cutoff is a fence beyond the group's quartiles. Small groups use their language's cutoff, small
languages the corpus's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .runtime import stored

#: Rules that hold for every text: words at least, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents from which a group's own sketch sets its cutoffs.
LEAST_GROUP = 200
#: Interquartile ranges that a fence is beyond the quartile, where a metric does not name its own.
FENCE = 8
#: Exact buckets, and bits below the leading one that larger values keep.
EXACT, KEPT_BITS = 64, 5


@dataclass(frozen=True)
class Metric:
    """A whole number from a text's counts, the least spread that it is given, which sides are cut, and how many spreads away."""

    name: str
    value: str
    spread: int
    low: bool = False
    high: bool = True
    fence: int = FENCE


#: Per thousand words or characters, so that buckets are whole numbers.
METRICS = (
    Metric("word_length", "word_chars * 100 div n_words", 10, low=True, fence=7),
    Metric("symbols", "n_symbols * 1000 div n_words", 10),
    Metric("upper", "n_upper * 1000 div greatest(word_chars, 1)", 2),
    Metric("repeat_words", "n_repeat_words * 1000 div n_words", 40),
    Metric("dup_lines", "n_dup_lines * 1000 div greatest(n_lines, 1)", 75),
)
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text, the first place included."""

    def of_windows(windows: Column) -> Column:
        """windows: structs of hash and place, sorted; those that equal a neighbour, back in order of place."""
        again = F.filter(windows, lambda w, i: (F.get(windows, i - 1)["h"] == w["h"]) | (F.get(windows, i + 1)["h"] == w["h"]))
        places = F.array_sort(F.transform(again, lambda w: w["i"]))
        return let(places, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"]))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed(h), of_windows)))

    return let(words, of_words).cast("bigint")


def row_hash(text: Column, lang: Column, source: Column) -> Column:
    """A hash of all that a verdict depends on."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("")) for c in (text, lang, source)])


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_hash and the counts that the rules read, for every whole text.

    Words are runs of characters other than ASCII white space; a null text has none. Windows are told
    apart by 64-bit hashes within a text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    t = F.col("text")
    solid = without(t, SPACE)
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: without(x, SPACE) != "")
    chars = lambda c: F.char_length(c).cast("bigint")
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = base.select("doc_id", "lang", "source", row_hash(t, F.col("lang"), F.col("source")).alias("row_hash"), chars(solid).alias("word_chars"), (chars(t) - chars(without(t, SYMBOLS))).alias("n_symbols"), (chars(t) - chars(F.translate(t, upper, ""))).alias("n_upper"), line_counts.alias("lines"), word_counts.alias("words"))
    return out.select(
        "doc_id", "lang", "source", "row_hash", F.col("words.n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_upper", F.col("lines.n").cast("bigint").alias("n_lines"),
        F.col("lines.dup").cast("bigint").alias("n_dup_lines"), F.col("words.again").alias("n_repeat_words"),
    )


def bucket(x: Column) -> Column:
    """The histogram bucket of a whole number from 0: itself below EXACT, then by its leading bits."""
    shift = F.length(F.bin(x)) - (KEPT_BITS + 1)
    return F.when(x < EXACT, x).otherwise((shift * (1 << KEPT_BITS) + F.call_function("shiftright", x, shift.cast("int")))).cast("bigint")


def bucket_value(b: Column) -> Column:
    """The least number of a bucket."""
    shift = F.floor(b / (1 << KEPT_BITS)) - 1
    return F.when(b < EXACT, b).otherwise(F.call_function("shiftleft", b - shift * (1 << KEPT_BITS), shift.cast("int"))).cast("bigint")


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): mergeable histograms of every group, partial sums before the shuffle."""
    metrics = F.array(*[F.struct(F.lit(m.name).alias("metric"), bucket(F.expr(m.value)).alias("bucket")) for m in METRICS])
    return counts.select("lang", "source", F.explode(metrics).alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def cutoffs(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Fences of each group of ``keys`` and metric, from its merged histogram: low, high and the group's size.

    A quantile is the least bucket at which the running count reaches its share.
    """
    merged = histograms.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    run = merged.select("*", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("n").over(w).alias("size"))
    quartile = lambda q: F.min(F.when(F.col("run") * 4 >= F.col("size") * q, bucket_value(F.col("bucket")))).alias(f"q{q}")
    found = run.groupBy(*keys, "metric").agg(quartile(1), quartile(3), F.first("size").alias("size"))
    of = lambda value: F.expr("CASE metric " + " ".join(f"WHEN '{m.name}' THEN {getattr(m, value)}" for m in METRICS) + " END")
    width = F.greatest(F.col("q3") - F.col("q1"), of("spread")) * of("fence")
    cut = lambda side: F.col("metric").isin([m.name for m in METRICS if getattr(m, side)])
    return found.select(*keys, "metric", "size", F.when(cut("low"), F.col("q1") - width).alias("low"), F.when(cut("high"), F.col("q3") + width).alias("high"))


def thresholds(counts: DataFrame) -> DataFrame:
    """One row for each (lang, source) with a low and a high cutoff for every metric."""
    parts = stored(sketches(counts))
    own = cutoffs(parts, ["lang", "source"])
    by_lang = cutoffs(parts, ["lang"]).select("lang", "metric", F.col("size").alias("lang_size"), F.col("low").alias("lang_low"), F.col("high").alias("lang_high"))
    overall = cutoffs(parts, []).select("metric", F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    side = lambda s: F.when(F.col("size") >= LEAST_GROUP, F.col(s)).when(F.col("lang_size") >= LEAST_GROUP, F.col(f"lang_{s}")).otherwise(F.col(f"all_{s}"))
    chosen = own.join(by_lang, ["lang", "metric"]).join(overall, "metric").select("lang", "source", "metric", side("low").alias("low"), side("high").alias("high"))
    pick = lambda m, s: F.max(F.when(F.col("metric") == m.name, F.col(s))).alias(f"{m.name}_{s}")
    return chosen.groupBy("lang", "source").agg(*[pick(m, s) for m in METRICS for s in ("low", "high") if getattr(m, s)])


def judged(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, source, its counts, base_failed, failed_metric and kept.

    base_failed: too few words, or too many of them repeated. A text that passes is kept if all its
    metrics are within the cutoffs of its language and source; failed_metric names the first that is
    not. Only texts that pass the base rules enter the sketches. Null lang and source are groups of
    their own (empty names); an empty table gives an empty result; repeated rows count each.
    """
    counts = stored(with_counts(docs))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    counts = counts.withColumn("base_failed", failed)
    cut = stored(thresholds(counts.filter("not base_failed")))
    rows = counts.join(cut, ["lang", "source"], "left")
    reason = F.lit(None).cast("string")
    for m in reversed(METRICS):
        value = F.expr(f"CASE WHEN n_words > 0 THEN {m.value} END")
        outside = F.lit(False)
        if m.low:
            outside = outside | (value < F.col(f"{m.name}_low"))
        if m.high:
            outside = outside | (value > F.col(f"{m.name}_high"))
        reason = F.when(F.coalesce(outside, F.lit(False)), F.lit(m.name)).otherwise(reason)
    rows = rows.withColumn("failed_metric", F.when(~F.col("base_failed"), reason))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("failed_metric").isNull()).select(*counts.columns, "failed_metric", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. Rows are told apart by doc_id, text, lang and source; a null doc_id is one of its own."""
    kept = judged(docs).filter("kept").select("doc_id", "row_hash")
    same = docs["doc_id"].cast("bigint").eqNullSafe(kept["doc_id"]) & (row_hash(docs["text"], docs["lang"], docs["source"]) == kept["row_hash"])
    return docs.join(kept, same, "left_semi")


def oracle_sql() -> str:
    """DuckDB SQL for the query's columns."""
    value = {m.name: m.value.replace(" div ", " // ") for m in METRICS}
    spread, fence = ("CASE metric " + " ".join(f"WHEN '{m.name}' THEN {getattr(m, v)}" for m in METRICS) + " END" for v in ("spread", "fence"))
    metrics = "\n  UNION ALL ".join(f"SELECT lang, source, '{m.name}' AS metric, {value[m.name]} AS x FROM c WHERE NOT base_failed" for m in METRICS)

    def fences(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""{name} AS (
  SELECT {by}metric, size, q1 - ({fence}) * greatest(q3 - q1, {spread}) AS low, q3 + ({fence}) * greatest(q3 - q1, {spread}) AS high FROM (
    SELECT {by}metric, min(CASE WHEN run * 4 >= size THEN b END) AS q1, min(CASE WHEN run * 4 >= size * 3 THEN b END) AS q3, any_value(size) AS size FROM (
      SELECT {by}metric, b, sum(n) OVER (PARTITION BY {by}metric ORDER BY b) AS run, sum(n) OVER (PARTITION BY {by}metric) AS size
      FROM (SELECT {by}metric, b, count(*) AS n FROM m GROUP BY ALL)) GROUP BY {by}metric))"""

    tests = []
    for m in METRICS:
        inside = [f"{value[m.name]} < low"] * m.low + [f"{value[m.name]} > high"] * m.high
        tests.append(f"WHEN '{m.name}' THEN {' OR '.join(inside)}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1),
again AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY r),
k AS (SELECT r, doc_id, lang, source, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols,
  len(regexp_extract_all(t, '[A-Z]'))::bigint AS n_upper, len(ls)::bigint AS n_lines, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines FROM w),
c AS (SELECT k.*, coalesce(again.n, 0)::bigint AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * coalesce(again.n, 0) > {MOST_REPEATED} * n_words AS base_failed FROM k LEFT JOIN again USING (r)),
x AS ({metrics}),
m AS (SELECT lang, source, metric, CASE WHEN x < {EXACT} THEN x ELSE (x >> (length(bin(x)) - {KEPT_BITS + 1})) << (length(bin(x)) - {KEPT_BITS + 1}) END AS b FROM x),
{fences("own", "lang, source")},
{fences("by_lang", "lang")},
{fences("overall", "")},
cut AS (SELECT own.lang, own.source, own.metric,
  CASE WHEN own.size >= {LEAST_GROUP} THEN own.low WHEN by_lang.size >= {LEAST_GROUP} THEN by_lang.low ELSE overall.low END AS low,
  CASE WHEN own.size >= {LEAST_GROUP} THEN own.high WHEN by_lang.size >= {LEAST_GROUP} THEN by_lang.high ELSE overall.high END AS high
  FROM own JOIN by_lang USING (lang, metric) JOIN overall USING (metric)),
bad AS (SELECT DISTINCT r FROM c JOIN cut USING (lang, source) WHERE NOT base_failed AND CASE metric {" ".join(tests)} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM c LEFT JOIN bad USING (r)"""
