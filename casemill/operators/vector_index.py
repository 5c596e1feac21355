"""An inverted-file index for vector search: rows by the nearest of a number of centroids, queries that probe some lists and rank them exactly.

Centroids and the number of lists to probe are fitted on a bounded sample (``SAMPLE_ROWS``); every row is assigned and
written. The index is a Parquet table of blocks of one list each, ordered by list, so that a scan for few lists skips the
other row groups; lists of any size span many blocks, files and tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from casemill.operators import retrieval
from casemill.session import ship_package

#: Rows that centroids are fitted on at most, rows of the sample for each centroid, and centroids at most (fixed bounds of what the driver holds).
SAMPLE_ROWS, ROWS_A_LIST, MOST_LISTS = 65_536, 16, 2_048
#: Rounds of k-means, sample queries that set the number of probed lists, and the share of their neighbours that must be found.
ROUNDS, TRIALS, SHARE = 8, 256, 0.97

#: Rows of queries and lists that a search makes at a time.
SPREAD_ROWS = 8_192


@dataclass
class VectorIndex:
    """A written index: its folder, centroids (unit vectors for cosine), how many lists a query probes, and its metric."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int
    metric: str

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def build(corpus: DataFrame, path: str, metric: str = "cosine", neighbours: int = 10, id_col: str = "id", vector_col: str = "embedding") -> VectorIndex:
    """Write the index of all rows with a vector to ``path``.

    The number of lists is the root of the number of rows, at least 1, at most ``MOST_LISTS`` and one for every
    ``ROWS_A_LIST`` rows of the sample. Vectors must be of one length (a ValueError otherwise); null vectors are left out, and
    vectors with components that are no numbers go to the first list and are never hits. An empty table gives an empty index.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    rows = corpus.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components can't share an index")
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), "vector"), F.lit(1 << 20)) < F.lit(max(1.0, (1 << 20) * min(1.0, SAMPLE_ROWS / max(1, n))))
    taken = rows.where(drawn).select("vector").limit(2 * SAMPLE_ROWS).collect()  # about SAMPLE_ROWS
    sample = np.array([r[0] for r in taken], float).reshape(len(taken), least or 0)
    sample = _scaled(sample[np.isfinite(sample).all(axis=1)], metric)
    lists = int(max(1, min(MOST_LISTS, n**0.5, len(sample) / ROWS_A_LIST)))
    centroids = fit_centroids(sample, lists)
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_LISTS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = nearest_lists(np.nan_to_num(_scaled(vectors, metric)), shared.value, 1)[:, 0] if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64))], ["id", "vector", "list"])

    id_type = rows.schema["id"].dataType.simpleString()
    assigned = rows.mapInArrow(assign, f"id {id_type}, vector array<double>, list bigint")
    # ranges of (list, hash): a list that holds much is spread over tasks, small ones share a task
    ordered = assigned.withColumn("deal", F.xxhash64(F.col("id").cast("string"))).repartitionByRange("list", "deal").sortWithinPartitions("list")
    retrieval.vector_blocks(ordered, "id", "vector", F.lit(""), retrieval.CORPUS_BLOCK, key="list").write.parquet(f"{path}/blocks")
    index = VectorIndex(spark, path, centroids, probes_needed(sample, centroids, neighbours), metric)
    save = json.dumps({"metric": metric, "probes": index.probes, "centroids": centroids.tolist()})
    spark.createDataFrame([(save,)], "value string").write.text(f"{path}/centroids")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """A written index."""
    saved = json.loads(spark.read.text(f"{path}/centroids").first()[0])
    return VectorIndex(spark, path, np.array(saved["centroids"], float), saved["probes"], saved["metric"])


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, vector_col: str = "embedding", query_col: str = "query_id", drop_self: bool = True) -> DataFrame:
    """query_id, id, score, rank: the k best rows of the lists nearest to each query, ranked by exact scores.

    With ``probes`` at the number of lists the result is that of the exact search. Queries of one list are packed into
    blocks that meet the list's blocks, so what is compared grows with the lists that are probed, not with the table.
    """
    shared, metric = index.spark.sparkContext.broadcast(index.centroids), index.metric
    probed = min(len(index.centroids), probes or index.probes)
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = asked.where(F.size("vector") == index.centroids.shape[1])
    query_type = asked.schema["query_id"].dataType

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SPREAD_ROWS // probed)  # a query becomes as many rows as it probes lists
            for part in (batch.slice(start, step) for start in range(0, batch.num_rows, step)):
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                near = nearest_lists(np.nan_to_num(_scaled(vectors, metric)), shared.value, probed)
                again = part.take(pa.array(np.repeat(np.arange(part.num_rows), probed)))
                yield pa.RecordBatch.from_arrays([again.column(0).cast(to_arrow_type(query_type)), again.column(1), pa.array(near.ravel().astype(np.int64))], ["query_id", "vector", "list"])

    spread = asked.mapInArrow(choose, f"query_id {query_type.simpleString()}, vector array<double>, list bigint")
    packed = retrieval.vector_blocks(spread.repartition("list").sortWithinPartitions("list"), "query_id", "vector", F.lit(""), retrieval.QUERY_BLOCK, key="list")
    met = index.blocks().join(packed.withColumnsRenamed({c: f"q_{c}" for c in packed.columns if c != "list"}), "list").drop("list")
    return retrieval.rank_hits(retrieval.block_search(met, k, metric, drop_self=drop_self), k)


def scanned_share(index: VectorIndex, queries: DataFrame, probes: int | None = None, vector_col: str = "embedding") -> float:
    """The share of all pairs of a query and a row that a search compares."""
    sizes = {r["list"]: r["n"] for r in index.blocks().groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect()}  # one row a list
    probed = min(len(index.centroids), probes or index.probes)
    weight = np.array([sizes.get(n, 0) for n in range(len(index.centroids))], float)
    total, asked, met = weight.sum(), 0, 0.0
    for row in queries.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v")).toLocalIterator():
        near = nearest_lists(np.nan_to_num(_scaled(np.array([row["v"]]), index.metric)), index.centroids, probed)[0]
        asked, met = asked + 1, met + weight[near].sum()
    return met / (asked * total) if asked and total else 0.0


def _scaled(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Unit vectors for cosine; zero vectors stay."""
    if metric != "cosine" or not len(vectors):
        return vectors
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def nearest_lists(vectors: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` centroids nearest to each vector, nearest first, ties to the smaller number."""
    out = np.empty((len(vectors), most), int)
    squares = (centroids**2).sum(axis=1)
    for start in range(0, len(vectors), 1024):
        apart = squares[None, :] - 2 * vectors[start : start + 1024] @ centroids.T
        out[start : start + 1024] = np.argsort(apart, axis=1, kind="stable")[:, :most]
    return out


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by k-means from evenly spaced rows of the sample; a centroid without rows stays."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest_lists(sample, centroids, 1)[:, 0]
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=lists)
        np.add.at(sums, near, sample)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def probes_needed(sample: np.ndarray, centroids: np.ndarray, neighbours: int) -> int:
    """The fewest lists that hold ``SHARE`` of the nearest neighbours of the sample's first rows within the sample."""
    if len(sample) <= neighbours:
        return len(centroids)
    homes = nearest_lists(sample, centroids, 1)[:, 0]
    found = np.zeros(len(centroids))
    trials = sample[:: max(1, len(sample) // TRIALS)]
    for vector, order in zip(trials, nearest_lists(trials, centroids, len(centroids)), strict=True):
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        near = np.argsort(-(sample @ vector), kind="stable")[: neighbours + 1]  # itself and its neighbours
        np.add.at(found, place[homes[near[1:]]], 1)
    return int(np.searchsorted(np.cumsum(found) / found.sum(), SHARE) + 1)
