"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is named and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = getattr(spark.sparkContext, "_casemill_scratch", None) or "file://" + tempfile.mkdtemp(prefix="casemill-")
        spark.sparkContext._casemill_scratch = named
    return named.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/casemill-{tag}-{uuid.uuid4().hex}"


def written(frame: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``frame`` written as Parquet and read again: lineage ends here, and Spark knows its size and can split its keys in joins."""
    spark = frame.sparkSession
    path = path or fresh(spark, tag)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
