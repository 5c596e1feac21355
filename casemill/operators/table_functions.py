"""Searches as table functions of SQL: registered for a table, called laterally for each row of another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from casemill.scratch import fresh
from casemill.session import ship_package
from casemill.sources.records import file_system

#: Rows of the table that a call compares at a time: of each block it keeps its best and no more. Rows of it that a task reads at a time, and scores that it holds.
BLOCK, SLICE, CELLS = 1 << 15, 4096, 1 << 20


def register_match(spark: SparkSession, name: str, table: str, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding") -> None:
    """``name(query, threshold, most, own)`` over the view or table ``table``: all its columns but the vector, ``similarity`` and ``rank``.

    ``SELECT q.id, m.* FROM asked q, LATERAL name(q.embedding, 0.2D, 10, q.id) m`` searches for every row; filters on
    ``q`` belong into a subquery, as Spark forms the distinct queries before it looks at what stands behind. The threshold is strict and
    holds for the cosine metric only, as in the other searches; null means none. ``own`` is an id that is left out, null
    for none. Ties go to the smaller id. Null vectors, vectors of another length and scores that are no numbers are no hits.

    The table is written here, as it is now, in blocks of about ``BLOCK`` rows by the hash of their ids. Spark turns the lateral call into a join of the
    distinct queries with the numbers of the blocks (the view ``name_blocks``); a worker reads the blocks of a batch of calls one after the other, a
    slice at a time, and of each query and block the ``most`` best are rows that carry the query on: what is sorted and shuffled is these,
    not all pairs. A matrix product says which rows may be among the best; their scores are then added up in the vectors' order, so that equal vectors score alike.
    """
    ship_package(spark)
    frame = spark.table(table)
    kept = [field for field in frame.schema.fields if field.name != vector_col]
    own = frame.schema[id_col].dataType.simpleString()
    returned = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in kept)
    names = ", ".join(f"`{field.name}`" for field in kept)
    blocks = max(1, frame.count() // BLOCK)
    root = _written_blocks(frame, kept, id_col, vector_col, blocks)
    spark.range(blocks).withColumnRenamed("id", "block").createOrReplaceTempView(f"{name}_blocks")
    spark.udf.register(f"{name}_best", _best_of_blocks(root, StructType(kept), id_col, metric))
    columns = ", ".join(f"unit.`{field.name}` AS `{field.name}`" for field in kept)
    best = f"{name}_best(b.block, {name}.query, {name}.threshold, {name}.most, {name}.own)"
    # inline_outer, as for inline Spark asks below it whether there are hits and scores all pairs for that once more
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, threshold DOUBLE, most INT, own {own})
        RETURNS TABLE ({returned}, similarity DOUBLE, rank INT)
        RETURN SELECT {names}, similarity, __place FROM (
            SELECT *, row_number() OVER (ORDER BY similarity DESC, `{id_col}`) AS __place FROM (
                SELECT {columns}, similarity FROM (SELECT inline_outer(hits) FROM (SELECT {best} AS hits FROM {name}_blocks b)) WHERE similarity IS NOT NULL))
        WHERE __place <= {name}.most""")


def _written_blocks(frame: DataFrame, kept: list, id_col: str, vector_col: str, blocks: int) -> str:
    """The folder of the table's blocks: unit and vector of each row, in the order of the ids."""
    root = fresh(frame.sparkSession, "match")
    rows = frame.where(F.col(vector_col).isNotNull()).select(
        F.struct(*[F.col(f"`{field.name}`") for field in kept]).alias("unit"), F.col(vector_col).cast("array<double>").alias("vector"), F.expr(f"pmod(xxhash64(`{id_col}`), {blocks})").alias("block"))
    rows.repartition(blocks, "block").sortWithinPartitions("block", f"unit.{id_col}").write.partitionBy("block").parquet(root)
    return root


def _best_of_blocks(root: str, unit: StructType, id_col: str, metric: str):
    """The function of SQL that gives the best of a block for a query: structs of similarity and unit."""
    kind = to_arrow_type(unit)
    hit = pa.struct([("similarity", pa.float64()), ("unit", kind)])

    @F.arrow_udf(f"array<struct<similarity:double,unit:{unit.simpleString()}>>")
    def best(block: pa.Array, query: pa.Array, threshold: pa.Array, most: pa.Array, own: pa.Array) -> pa.Array:
        calls, scores, units = [np.empty(0, np.int64)], [np.empty(0)], [pa.array([], kind)]
        numbers = block.to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(query).fill_null(-1).to_numpy(zero_copy_only=False)
        limits = np.maximum(most.fill_null(0).to_numpy(zero_copy_only=False), 0)
        bounds = threshold.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False) if metric == "cosine" else np.full(len(block), -np.inf)
        for number in np.unique(numbers):
            asked = np.flatnonzero((numbers == number) & (lengths >= 0) & (limits > 0))
            groups = [asked[lengths[asked] == dim] for dim in np.unique(lengths[asked])]
            vectors = [query.take(pa.array(group)).flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1) for group in groups]
            for rows, given in _slices(root, number):
                rows = rows if rows.type == kind else rows.cast(kind)
                sizes = pc.list_value_length(given).to_numpy(zero_copy_only=False)
                for group, wanted in zip(groups, vectors, strict=True):
                    at = np.flatnonzero(sizes == wanted.shape[1])
                    if not len(at):
                        continue
                    taken = rows.take(pa.array(at))
                    matrix = given.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    step = max(1, CELLS // len(at))
                    for start in range(0, len(group), step):
                        part = group[start : start + step]
                        allowed = ~_own(taken.field(id_col), own.take(pa.array(part)))
                        which, hits, near = _near(matrix, wanted[start : start + step], allowed, limits[part], bounds[part], metric)
                        calls.append(part[which])
                        scores.append(near)
                        units.append(taken.take(pa.array(hits)))
        call, score = np.concatenate(calls), np.concatenate(scores)
        order = np.lexsort((-score, call))  # stable: slices of a block come by id
        begins = np.searchsorted(call[order], np.arange(len(block)))
        order = order[np.arange(len(order)) - begins[call[order]] < limits[call[order]]]
        found = pa.StructArray.from_arrays([pa.array(score[order]), pa.concat_arrays(units).take(pa.array(order))], fields=list(hit))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(call[order], np.arange(len(block) + 1)), pa.int32()), found)

    return best


def _slices(root: str, number: int) -> Iterator[tuple[pa.StructArray, pa.ListArray]]:
    """Units and vectors of a block, ``SLICE`` rows at a time; none where no id falls into it."""
    system, folder = file_system(f"{root}/block={number}")
    for file in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda info: info.path):
        if file.path.endswith(".parquet"):
            with system.open_input_file(file.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(SLICE):
                    yield batch.column("unit"), batch.column("vector")


def _own(ids: pa.Array, own: pa.Array) -> np.ndarray:
    """Which ids (down) are a call's own (across); null is nobody's."""
    codes = pa.concat_arrays([ids.cast(own.type), own]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    one, two = codes[: len(ids)], codes[len(ids) :]
    return (one[:, None] == two[None, :]) & (one >= 0)[:, None]


def _in_order(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of products, added from the first component to the last."""
    return np.add.accumulate(one * two, axis=1)[:, -1] + 0.0 if one.shape[1] else np.zeros(len(one))


def _near(matrix: np.ndarray, wanted: np.ndarray, allowed: np.ndarray, limits: np.ndarray, bounds: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and scores of the best of each query; the rows come by id."""
    with np.errstate(all="ignore"):
        scores = matrix @ wanted.T
        error = 4.0 * (matrix.shape[1] + 4) * np.finfo(float).eps  # of the product and of the sum in order, for vectors of length 1
        size, asked = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (matrix, wanted))
        if metric == "cosine":
            scores /= size[:, None] * asked[None, :]
            slack = np.full(len(wanted), error)
        else:
            slack = error * asked * size.max()
        slack[np.isnan(slack)] = np.inf
        allowed = allowed & ~np.isnan(scores)
        if len(matrix) > limits.min():
            ranked = np.where(allowed, scores, -np.inf)
            for limit in np.unique(limits):
                mine = limits == limit
                if len(matrix) > limit:
                    last = np.partition(ranked[:, mine], len(matrix) - limit, axis=0)[len(matrix) - limit]
                    least = np.where(np.isfinite(last), last - 2 * slack[mine], -np.inf)
                    allowed[:, mine] &= ranked[:, mine] >= least
        at, which = np.nonzero(allowed)
        near = np.concatenate([_in_order(matrix[at[n : n + SLICE]], wanted[which[n : n + SLICE]]) for n in range(0, len(at), SLICE)] or [np.empty(0)])
        if metric == "cosine":
            near = near / (np.sqrt(_in_order(matrix, matrix))[at] * np.sqrt(_in_order(wanted, wanted))[which])
    good = np.flatnonzero(~np.isnan(near) & ((near > bounds[which]) | np.isneginf(bounds[which])))
    good = good[np.lexsort((-near[good], which[good]))]  # stable: rows come by id
    good = good[np.arange(len(good)) - np.searchsorted(which[good], np.arange(len(wanted)))[which[good]] < limits[which[good]]]
    return which[good], at[good], near[good]
