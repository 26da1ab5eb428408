"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import gzip
import html
import html.entities
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import arrow_session

#: Date of records whose response names none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Character references: numbers, or what may be a name, with or without a semicolon.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: The character references that the SQL resolves; ``plain_text`` resolves all of HTML. Ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Elements whose content is no text. One pattern each, for a pattern cannot refer back in every engine.
HIDDEN = ("script", "style", "noscript", "template")
#: Elements that begin and end a line.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"

RESPONSE = "record_id string, target_uri string, warc_date string, content_type string, payload string, payload_digest string, http_headers string"
#: Patterns of text extraction in order, with their replacements, as SQL applies them; ``visible`` does the same in linear time.
STEPS = (
    ("(?s)<!--.*?-->", " "),
    *((f"(?is)<{e}\\b[^>]*>.*?</{e}\\s*>", " ") for e in HIDDEN),
    (f"(?i)</?(?:{BLOCKS})\\b[^>]*>", "\n"),
    ("<[^>]*>", ""),
    ("[ \\t\\r\\f\\x0B]+", " "),
    (" ?\\n[ \\n]*", "\n"),
    ("^[ \\n]+|[ \\n]+$", ""),
)


BLOCK_TAG = re.compile(f"(?i)</?(?:{BLOCKS})\\b[^>]*>".encode())
ANY_TAG, SPACES, LINES = re.compile(b"<[^>]*>"), re.compile(b"[ \\t\\r\\f\\x0B]+"), re.compile(b" ?\\n[ \\n]*")
CLOSED = re.compile(b"[ \\t\\n\\r\\f]*>")
WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789_")


def without_comments(page: bytes) -> bytes:
    out, done = [], 0
    while (start := page.find(b"<!--", done)) >= 0 and (stop := page.find(b"-->", start + 4)) >= 0:
        out += [page[done:start], b" "]
        done = stop + 3
    return b"".join([*out, page[done:]]) if out else page


def without_element(page: bytes, name: bytes) -> bytes:
    """A page without the elements of a name that are closed. The first that is not closed is the last to look at: none after it can be."""
    lower = page.lower()
    opening, closing = b"<" + name, b"</" + name
    out, done, at = [], 0, 0
    while (start := lower.find(opening, at)) >= 0:
        at = start + len(opening)
        if lower[at : at + 1] and lower[at] in WORD:
            continue
        stop = lower.find(b">", at)
        end = None
        while stop >= 0 and (close := lower.find(closing, stop + 1)) >= 0:
            end = CLOSED.match(lower, close + len(closing))
            if end:
                break
            stop = close + len(closing) - 1
        if not end:
            break
        out += [page[done:start], b" "]
        done = at = end.end()
    return b"".join([*out, page[done:]]) if out else page


def visible(page: str) -> str:
    """Text of a page: comments, hidden elements and tags go, blocks become lines, references are resolved. Every step is one pass, whatever is left unclosed."""
    raw = without_comments(page.encode())
    for name in HIDDEN:
        raw = without_element(raw, name.encode())
    for pattern, by in ((BLOCK_TAG, b"\n"), (ANY_TAG, b"")):
        last = raw.rfind(b">") + 1  # nothing after it ends a tag
        raw = pattern.sub(by, raw[:last]) + raw[last:]
    return resolved(LINES.sub(b"\n", SPACES.sub(b" ", raw)).strip(b" \n").decode())


def resolved(text: str) -> str:
    """All of HTML's named and numeric references resolved once, so that ``&amp;lt;`` is ``&lt;``; a no-break space is a space."""

    def character(m: re.Match) -> str:
        said = m[0]
        if said[1] == "#" and said[2] not in "xX":  # a number of any length: zeros before it go, and beyond eight digits it is no character
            digits = said[2:].rstrip(";").lstrip("0")
            said = f"&#{digits or '0'};" if len(digits) <= 8 else "&#99999999;"
        out = html.unescape(said)
        return " " + out[1:] if out[0:1] == "\xa0" else out

    return REFERENCE.sub(character, text) if "&" in text else text


def plain_text(page: Column) -> Column:
    """``visible`` of a page; that of a null is empty."""

    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(visible)

    return extract(F.coalesce(page, F.lit("")))


def urn(*parts: Column) -> Column:
    """A record id that depends on its parts alone, so that a repeated run links the same records."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Pages as responses; a null body is an empty payload, a null url an empty target."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), urn(F.lit("response"), F.col("page_id"), uri, F.sha2(F.encode(payload, "UTF-8"), 256)).alias("record_id"),
        uri.alias("target_uri"), F.lit(NO_DATE).alias("warc_date"), F.lit("text/html").alias("content_type"), payload.alias("payload"), digest(payload).alias("payload_digest"),
    )


#: Columns of derived records, besides those of the source that stay.
DERIVED = ("warc_type", "warc_record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_content_type", "source_payload_digest", "block_digest", "content_length", "block")


def derive(source: DataFrame) -> DataFrame:
    """Two linked records for each response: its plain text and metadata on both.

    The ``conversion`` record refers to the response and keeps its target and date; the ``metadata``
    record refers to the response as well and names, in its block, the conversion, the source's digest,
    sizes and headers, one field a line: every line of ``http_headers``, where the source has that
    column, is a ``source-http-header``. Ids follow from the response's id, repeated responses give
    repeated records, an empty table gives none; nulls in the payload, target or headers are empty.
    Columns of ``source`` besides those of a response stay, before the others; one that has the name of
    a derived column gets ``source_`` before it until it is told apart.
    """
    arrow_session(source.sparkSession)
    response = [c.split()[0] for c in RESPONSE.split(", ")]
    kept, names = [c for c in source.columns if c not in response], set(source.columns) | set(DERIVED)
    renamed = []
    for c in kept:
        name = c
        while name in DERIVED or (name != c and name in names):
            name = f"source_{name}"
        names.add(name)
        renamed.append(F.col(f"_row.`{c}`").alias(name))
    text = lambda c: F.coalesce(F.col(f"_row.{c}"), F.lit(""))
    # All columns in one struct: working columns cannot clash with them.
    rows = source.select(F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("_row"))
    rows = rows.select("_row", plain_text(text("payload")).alias("_text")).withColumns({"_conversion": urn(F.lit("conversion"), F.col("_row.record_id")), "_digest": digest(F.col("_text"))})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    fields = F.concat(
        line("source-record-id", text("record_id")), line("source-content-type", text("content_type")), line("source-date", text("warc_date")),
        line("source-payload-digest", text("payload_digest")), line("source-payload-length", F.octet_length(text("payload"))),
        line("conversion-record-id", F.col("_conversion")), line("conversion-block-digest", F.col("_digest")), line("conversion-length", F.octet_length("_text")),
    )
    if "http_headers" in source.columns:
        heads = F.filter(F.split(text("http_headers"), "\r?\n"), lambda h: h != "")
        fields = F.concat(fields, F.array_join(F.transform(heads, lambda h: F.concat(F.lit("source-http-header: "), h, F.lit("\r\n"))), ""))
    records = F.array(
        F.struct(F.lit("conversion").alias("warc_type"), F.col("_conversion").alias("id"), F.lit("text/plain; charset=utf-8").alias("kind"), F.col("_text").alias("block")),
        F.struct(F.lit("metadata").alias("warc_type"), urn(F.lit("metadata"), F.col("_row.record_id")).alias("id"), F.lit("application/warc-fields").alias("kind"), fields.alias("block")),
    )
    out = rows.select("_row", F.explode(records).alias("_record"))
    block = F.col("_record.block")
    return out.select(
        *renamed, F.col("_record.warc_type").alias("warc_type"), F.col("_record.id").alias("warc_record_id"), F.col("_row.record_id").alias("refers_to"), F.col("_row.target_uri").alias("target_uri"), F.col("_row.warc_date").alias("warc_date"),
        F.col("_record.kind").alias("content_type"), F.col("_row.content_type").alias("source_content_type"), F.col("_row.payload_digest").alias("source_payload_digest"),
        digest(block).alias("block_digest"), F.octet_length(block).cast("bigint").alias("content_length"), block.alias("block"),
    )


def parse_warc(raw: bytes) -> Iterator[dict]:
    """Response records of a WARC file, gzipped by record or plain. Other record types are skipped."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        block = stream.read(int(head.get("content-length", 0)))
        if head.get("warc-type") != "response":
            continue
        http, _, body = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
        kind = re.search(rb"(?im)^content-type:\s*([^\r\n]+)", http)
        charset = re.search(rb"charset=[\"']?([\w-]+)", kind[1] if kind else b"")
        try:
            text = body.decode(charset[1].decode() if charset else "utf-8", "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
        yield {
            "record_id": head.get("warc-record-id", ""), "target_uri": head.get("warc-target-uri", ""), "warc_date": head.get("warc-date", NO_DATE),
            "content_type": kind[1].decode("latin-1").strip() if kind else "text/html", "payload": text, "payload_digest": head.get("warc-payload-digest"),
            "http_headers": http.decode("latin-1"),
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses of WARC files, one task reading a file at a time; a file must fit a worker (they are about 1 GB).

    A response without a payload digest gets one of its decoded payload; its HTTP status line and
    headers stay whole. Batches of files are bounded by Spark's bytes of an Arrow batch.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                batch: list[dict] = []
                for record in parse_warc(bytes(raw)):
                    batch.append(record)
                    if len(batch) == 256:
                        yield pd.DataFrame(batch)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch)

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, RESPONSE)
    return found.withColumn("payload_digest", F.coalesce("payload_digest", digest(F.col("payload"))))


def serialised(records: DataFrame) -> DataFrame:
    """Records of ``derive`` as WARC text (column ``value``), ready for a text sink with an empty line separator.

    The digest is that of the record's own block. The source's target and date are those that the
    record refers to; its digest is a field of the metadata record. Headers without a value are left out.
    """
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "warc_record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.coalesce(F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit("\r\n")), F.lit("")) for n, c in head]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.coalesce("block", F.lit("")), F.lit("\r\n\r\n")).alias("value"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_steps(column: str) -> str:
    """DuckDB's form of the patterns of text extraction."""
    out = f"coalesce({column}, '')"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {'chr(10)' if by == chr(10) else quoted(by)}, 'g')"
    return out


def oracle_reference(ref: str, names: str) -> str:
    """DuckDB SQL for what one character reference stands for, by HTML's rules; ``names`` is a map of names without the ampersand.

    A number is a code point; some control characters stand for those of Windows-1252, what is no
    character is left out or U+FFFD. A name that is not known may begin with one that needs no semicolon.
    """
    code = f"coalesce(CASE WHEN regexp_full_match({ref}, '&#[xX].*') THEN try_cast('0x' || regexp_extract({ref}, '[xX]0*([0-9a-fA-F]+)', 1) AS BIGINT) ELSE try_cast(regexp_extract({ref}, '[0-9]+') AS BIGINT) END, 1114112)"
    windows = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(0x80, 0xA0))
    number = f"""CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) WHEN {code} = 13 THEN chr(13) WHEN {code} BETWEEN 128 AND 159 THEN substring({quoted(windows)}, ({code} - 127)::int, 1)
      WHEN {code} BETWEEN 1 AND 8 OR {code} = 11 OR {code} BETWEEN 14 AND 31 OR {code} = 127 OR {code} BETWEEN 64976 AND 65007 OR {code} % 65536 >= 65534 THEN '' ELSE chr({code}::int) END"""
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    begin = f"regexp_extract({ref}, '^&({'|'.join(bare)})', 1)"
    name = f"coalesce({names}[substring({ref}, 2)], CASE WHEN {begin} <> '' THEN {names}[{begin}] || substring({ref}, 2 + len({begin})) ELSE {ref} END)"
    return f"regexp_replace(CASE WHEN {ref} LIKE '&#%' THEN {number} ELSE {name} END, '^\\x{{A0}}', ' ')"


def oracle_text(source: str, column: str) -> str:
    """DuckDB tables that end in ``resolved``: the rows of ``source`` with ``txt``, the ``plain_text`` of ``column``."""
    entities = html.entities.html5
    reference = quoted(REFERENCE.pattern)
    return f"""names AS (SELECT map([{", ".join(quoted(n) for n in entities)}], [{", ".join(quoted(c) for c in entities.values())}]) AS known),
cut AS (SELECT *, regexp_extract_all(raw, {reference}) AS refs, string_split_regex(raw, {reference}) AS pieces FROM (SELECT *, {oracle_steps(column)} AS raw FROM {source})),
resolved AS (SELECT * EXCLUDE (raw, refs, pieces, known), array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce({oracle_reference("refs[i]", "known")}, '')), '') AS txt FROM cut, names)"""


def oracle_derivatives() -> str:
    """DuckDB SQL for the records of all pages."""

    def urn_sql(*parts: str) -> str:
        h = "md5(concat_ws(chr(31), " + ", ".join(parts) + "))"
        cut = ", ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || concat_ws('-', {cut}) || '>'"

    crlf = "chr(13) || chr(10)"
    fields = " || ".join(
        f"'{n}: ' || {v} || {crlf}"
        for n, v in (
            ("source-record-id", "record_id"), ("source-content-type", "'text/html'"), ("source-date", f"'{NO_DATE}'"), ("source-payload-digest", "payload_digest"),
            ("source-payload-length", "strlen(payload)::varchar"), ("conversion-record-id", "conversion_id"), ("conversion-block-digest", "'sha256:' || sha256(txt)"), ("conversion-length", "strlen(txt)::varchar"),
        )
    )
    return f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest,
  {urn_sql("'response'", "coalesce(page_id::varchar, '')", "coalesce(url, '')", "sha256(coalesce(html, ''))")} AS record_id FROM pages),
{oracle_text("r", "payload")},
m AS (SELECT *, {urn_sql("'conversion'", "record_id")} AS conversion_id FROM resolved),
d AS (
  SELECT page_id, 'conversion' AS warc_type, conversion_id AS warc_record_id, record_id AS refers_to, target_uri, payload_digest, 'text/plain; charset=utf-8' AS content_type, txt AS block FROM m
  UNION ALL
  SELECT page_id, 'metadata', {urn_sql("'metadata'", "record_id")}, record_id, target_uri, payload_digest, 'application/warc-fields', {fields} FROM m)
SELECT page_id, warc_type, warc_record_id, refers_to, target_uri, '{NO_DATE}' AS warc_date, content_type, 'text/html' AS source_content_type, payload_digest AS source_payload_digest,
  'sha256:' || sha256(block) AS block_digest, strlen(block)::bigint AS content_length, block FROM d"""
