"""Tables of the corpus store: definitions, columns added later, new versions of rewritten tables, rows from another database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Columns of a table of paragraphs or sentences.
UNITS = {
    "doc_id": "STRING NOT NULL", "text": "STRING NOT NULL", "section_title": "STRING", "section_number": "STRING", "sentence_index": "INT",
    "global_index": "INT", "court": "STRING", "decision": "STRING", "embedding": "ARRAY<FLOAT>",
}
HIGHLIGHTS = {"id": "STRING NOT NULL", "user_id": "STRING NOT NULL", "original_text": "STRING", "highlighted_text": "STRING", "summarization": "STRING", "sent_at": "TIMESTAMP", "summarized_at": "TIMESTAMP"}


def create_table(spark: SparkSession, name: str, columns: dict[str, str], location: str | None = None, by: tuple[str, ...] = ()) -> None:
    """Create ``name`` if it isn't there. ``by`` partitions it by columns, which takes the place of an index on them."""
    spec = ", ".join(f"`{column}` {kind}" for column, kind in columns.items())
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in by)})" if by else ""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({spec}) USING parquet{parts}{place}")


def add_missing_columns(spark: SparkSession, name: str, columns: dict[str, str]) -> list[str]:
    """Add the columns that the table lacks; their names. Rows that are there have null in them, and a second run changes nothing."""
    there = {c.lower() for c in spark.table(name).columns}
    missing = [column for column in columns if column.lower() not in there]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c}` {columns[c].removesuffix(' NOT NULL')}' for c in missing)})")
    return missing


def rewritten(spark: SparkSession, path: str, version: int, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Version ``version`` of a table as a change of the one before; no version is changed in place, and a replay overwrites its own.

    Any change, of one row too, rewrites the whole table: Parquet files can't be changed. Small changes are better gathered
    into one.
    """
    before = spark.read.parquet(f"{path}/v={version - 1}")
    change(before).write.mode("overwrite").parquet(f"{path}/v={version}")
    return spark.read.parquet(f"{path}/v={version}")


def read_sql(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table or a bracketed query of another database; with a numeric key and its bounds in ``parts`` ranges at a time."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()
