"""Stored responses as a data source: a log of segments that is read as a table or as a stream.

A segment is a folder of Parquet files, ``seg=00000000`` on, that is complete once its success marker stands.
A batch read has a partition a file, and leaves out what pushed filters rule out. A stream's offset is
the number of complete segments, so a restart goes on after the last one that was taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull

FORMAT = "stored_responses"
COLUMNS = (("inchikey", "string"), ("source", "string"), ("http_status", "int"), ("raw_json", "string"), ("fetched_at", "string"))
SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)
ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in COLUMNS])
SEGMENT = re.compile(r"seg=(\d{8})$")


@dataclass
class SegmentFile(InputPartition):
    uri: str


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def joined(uri: str, path: str) -> str:
    """The address of ``path`` on the file system of ``uri``."""
    m = re.match(r"([a-z0-9]+://[^/]*)", uri)
    return f"{m[1]}{path}" if m else f"file://{path}"


def segments(uri: str) -> list[list[str]]:
    """The files of complete segments, in order; they end before the first number that is missing or incomplete."""
    system, path = opened(uri)
    found: dict[int, list[str]] = {}
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        m = SEGMENT.search(info.path)
        if m and info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(info.path))
            if any(x.base_name == "_SUCCESS" for x in inside):
                found[int(m[1])] = sorted(joined(uri, x.path) for x in inside if x.base_name.endswith(".parquet"))
    out = []
    while len(out) in found:
        out.append(found[len(out)])
    return out


def file_rows(part: SegmentFile, equal: dict[str, list] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a file whose columns have one of the given values."""
    system, path = opened(part.uri)
    with system.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(8192, columns=[n for n, _ in COLUMNS]):
            rows = pa.Table.from_batches([batch]).cast(ARROW)
            for column, values in (equal or {}).items():
                rows = rows.filter(pc.is_in(rows.column(column), pa.array(values, ARROW.field(column).type)))
            yield from rows.to_batches()


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.equal = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and lists of values are applied here, with the statistics of row groups left to Parquet; all others are Spark's."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and all(v is not None for v in values):
                held = self.equal.get(f.attribute[0])
                self.equal[f.attribute[0]] = values if held is None else [v for v in held if v in values]
            elif not isinstance(f, IsNotNull) or f.attribute[0] not in self.equal:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [SegmentFile(uri) for files in segments(self.path) for uri in files]

    def read(self, partition: SegmentFile) -> Iterator[pa.RecordBatch]:
        return file_rows(partition, self.equal)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"segments": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"segments": len(segments(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [SegmentFile(uri) for files in segments(self.path)[start["segments"] : end["segments"]] for uri in files]

    def read(self, partition: SegmentFile) -> Iterator[pa.RecordBatch]:
        return file_rows(partition)

    def commit(self, end: dict) -> None:
        """Segments stay: others may read them."""


class StoredResponses(DataSource):
    """``spark.read.format("stored_responses").load(folder)``, and the same with readStream."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.dataSource.register(StoredResponses)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).load(path)


def stream_responses(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).load(path)


def append_segment(responses: DataFrame, path: str) -> int:
    """Write the next segment: its number. Two writers of one number meet at the folder, and one of them fails."""
    number = len(segments(path))
    responses.select(*[F.col(n).cast(t).alias(n) for n, t in COLUMNS]).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/seg={number:08}")
    return number


def lookup(keys: DataFrame, responses: DataFrame, key: str = "inchikey") -> DataFrame:
    """Each key with its latest response; http_status is null where there is none. Of equally late ones the greatest status and text wins. A null key has no response."""
    latest = responses.groupBy(F.col("inchikey").alias(key)).agg(F.max(F.struct("fetched_at", "http_status", "raw_json", "source")).alias("r"))
    return keys.join(latest, key, "left").select(*keys.columns, "r.source", "r.http_status", "r.raw_json", "r.fetched_at")


#: Fixed value: entries of one page; what is beyond it is not asked for.
PAGE = 1000


def activity_counts(responses: DataFrame) -> DataFrame:
    """inchikey, total (what the page says there is in all), listed (entries of the page, PAGE at most) and truncated, of activity pages; null where the text is no page."""
    page = F.try_parse_json("raw_json")
    total = F.try_variant_get(page, "$.page_meta.total_count", "bigint")
    entries = F.try_variant_get(page, "$.activities", "array<variant>")
    listed = F.least(F.size(entries), F.lit(PAGE)).cast("bigint")
    return responses.select("inchikey", total.alias("total"), F.when(entries.isNotNull(), listed).alias("listed"), (total > listed).alias("truncated"))
