"""Delimited, JSON and report files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions import text as tx
from casemill.session import ship_package
from casemill.sources import records

METADATA = T.MapType(T.StringType(), T.StructType([T.StructField("short_name", T.StringType()), T.StructField("year", T.StringType()), T.StructField("judges", T.ArrayType(T.StringType())), T.StructField("title", T.StringType())]))
#: Fields of a simplified query file (fixed values).
QUERY_FIELDS = ("court_opinion", "file_name", "test_paragraph")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header; cells may be quoted and hold newlines. No schema inference: all strings."""
    return spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines split at the first two tabs only, so the third field keeps quotes and tabs; header and empty lines go."""
    fields = F.split("value", "\t", 3)
    rows = spark.read.text(path).select(*[tx.strip(F.coalesce(F.get(fields, F.lit(n)), F.lit(""))).alias(name) for n, name in enumerate(QUERY_FIELDS)])
    header = F.lower("court_opinion").startswith("court")
    return rows.where(~(header & F.lower("file_name").startswith("file")) & (F.concat(*QUERY_FIELDS) != ""))


def read_records(spark: SparkSession, path: str, starts: tuple[str, ...] = ("UKSC", "Tribunal"), fields: int = 10, least: int = 6, range_bytes: int = records.RANGE_BYTES) -> DataFrame:
    """file, at, c0, c1...: records that begin at a newline and a court name, whose fields may hold newlines; padded to ``fields`` columns.

    Files are read by byte ranges, each task finishing the records that begin in its own; ``at`` is a record's first
    byte, so it orders a file's records. Records of fewer than ``least`` fields are left out.
    """
    ship_package(spark)
    records.register(spark)
    rows = spark.read.format("casemill_records").option("starts", "|".join(starts)).option("rangeBytes", range_bytes).load(path)
    cells = F.split("record", "\t")
    return rows.where(F.size(cells) >= least).select("file", "at", *[F.coalesce(F.get(cells, F.lit(n)), F.lit("")).alias(f"c{n}") for n in range(fields)])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of cases as rows: key, short_name, year, judges, title."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", METADATA).alias("m"))
    return whole.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def write_metadata(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """A quoted tab-separated report; cells are cleaned of tabs and newlines. ``by`` gives each value of a column a folder of its own."""
    cells = [F.col(c) if c == by else tx.sanitize_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in rows.columns]
    writer = rows.select(*cells).write.mode(mode)
    (writer.partitionBy(by) if by else writer).csv(path, sep="\t", header=True, quoteAll=True, escape='"')


def write_partitioned(rows: DataFrame, path: str, by: tuple[str, ...] = ("court", "decision")) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def split_valid(rows: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows fit for the vector table, and the rest for quarantine; NULs in texts become blanks."""
    cleaned = rows.withColumn("text", F.translate("text", "\x00", " ")) if "text" in rows.columns else rows
    good: Column = F.coalesce(F.size(F.col(vector)) == dim, F.lit(False))
    return cleaned.where(good), cleaned.where(~good)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_files(rows: DataFrame, folder: str, name: str, text: str, ending: str = ".md") -> int:
    """One file a row: its column ``text`` under the safe stem of ``name``, overwriting; how many were written.

    Tasks write their own rows by Arrow's file systems, each file whole or not at all; of rows with one stem one file is left, that of the
    larger text. Rows without a name or a text are left out.
    """
    ship_package(rows.sparkSession)
    given = rows.select(tx.file_stem(F.col(name).cast("string")).alias("stem"), F.col(text).alias("text")).where("stem <> '' AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = records.file_system(folder)
        system.create_dir(path, recursive=True)
        written = 0
        for batch in batches:
            for stem, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{path.rstrip('/')}/{stem}{ending}"
                with system.open_output_stream(f"{target}.part") as file:
                    file.write(body.encode())
                system.move(f"{target}.part", target)
                written += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    whole = given.groupBy("stem").agg(F.max("text").alias("text"))
    return whole.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
