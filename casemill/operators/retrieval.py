"""Exact vector top-k, context around hits, exclusion rules and pivoted reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from casemill.functions import text as tx
from casemill.functions import vector as vx
from casemill.models import Embedder, components_of

#: Vectors of one block of queries and of one block of the corpus: what a task holds of each at a time.
QUERY_BLOCK, CORPUS_BLOCK = 512, 2048
#: Candidates that wait at least until they are merged, and numbers of a query and a label that a task holds before it passes them on.
MERGE_ROWS, LABEL_CELLS = 1 << 18, 1 << 24
#: Texts of a block of rows and of one of queries, and queries whose scores a task holds at a time.
TEXT_BLOCK, TEXT_QUERIES, STEP = 1 << 15, 1024, 8
#: Products that a query adds to a block of texts one by one at most (on the average), and how many times dearer one is than a cell of a matrix product. Places of their scores.
SCATTERED, DEARER, PLACES = 1 << 21, 64, 9


def rank_hits(scored: DataFrame, k: int, query: str = "query_id", score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best rows of each query with their rank (from 1); ties by id. Spark limits the groups before it shuffles them."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(id_col).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_one(corpus: DataFrame, query: list[float], k: int, metric: str = "ip", threshold: float | None = None,
              id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """One query vector against all rows; planned as a top-k per task and a merge of k rows each.

    The threshold is strict and holds for the cosine metric only: inner-product search ignores it.
    """
    vector = F.array(*[F.lit(float(x)) for x in query])
    score = vx.inner_product(F.col(vector_col), vector) if metric == "ip" else vx.cosine(F.col(vector_col), vector)
    scored = corpus.withColumn("score", score).drop(vector_col)
    if metric == "cosine" and threshold is not None:
        scored = scored.where(F.col("score") > threshold)
    return scored.orderBy(F.col("score").desc(), F.col(id_col).asc()).limit(k)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "ip", threshold: float | None = None,
          same: str | None = None, id_col: str = "id", vector_col: str = "embedding", query_col: str = "query_id",
          drop_self: bool = True) -> DataFrame:
    """Batch search: (query_id, id, score, rank) of the k best rows of each query.

    Queries and corpus are packed into blocks where they lie, and every block of the one meets every block of the other
    (Spark broadcasts the queries only if it knows them to be small, and pairs partitions otherwise): nothing passes the driver, and a task
    holds a block of each and k candidates a query, merged by block of queries. Only those are shuffled. ``same`` names a column that must agree (a filter
    below the top-k); ``drop_self`` leaves out the query's own id. Rows and queries with a null vector are left out, and a
    query meets only rows whose vector is as long as its own; a score that is not a number is none. Ids may be of any type that
    Spark orders and keep it; null query ids are one query, and a null id is nobody's own.
    """
    rows = vector_blocks(corpus, id_col, vector_col, F.col(same) if same else F.lit(""), CORPUS_BLOCK)
    wanted = vector_blocks(queries, query_col, vector_col, F.col(same) if same else F.lit(""), QUERY_BLOCK).withColumn("block", F.monotonically_increasing_id())
    met = rows.crossJoin(wanted.withColumnsRenamed({c: f"q_{c}" for c in wanted.columns}))  # a stated query set against all rows, in blocks
    return rank_hits(block_search(met, k, metric, threshold, bool(same), drop_self), k)


def text_blocks(frame: DataFrame, id_col: str, text: Column, embed: Embedder, size: int, owner: Column | None = None, label: Column | None = None) -> DataFrame:
    """Embedded texts in blocks of at most ``size``, each in the order of its ids: ids, owners, labels, dim, and the vectors' components that are not zero. No shuffle.

    The components stand by place (counts by place, rows, values). A text is embedded once, ``CORPUS_BLOCK`` at a time; a block holds vectors of
    one length, and rows that stand together come into one block.
    """
    id_type = frame.schema[id_col].dataType

    def block(parts: list[tuple]) -> pa.RecordBatch:
        keys = pa.concat_arrays([part[0] for part in parts])
        order = pc.array_sort_indices(keys, null_placement="at_start")
        rank = np.empty(len(keys), np.int64)
        rank[order.to_numpy()] = np.arange(len(keys))
        starts = np.cumsum([0, *(len(part[0]) for part in parts)])
        at = rank[np.concatenate([part[3] + start for part, start in zip(parts, starts, strict=False)])]
        places, values = (np.concatenate([part[n] for part in parts]) for n in (4, 5))
        by_place = np.lexsort((at, places))
        dim = parts[0][6]
        return pa.RecordBatch.from_pydict({
            **{name: pa.array([pa.concat_arrays([part[n] for part in parts]).take(order).to_pylist()], pa.list_(parts[0][n].type)) for n, name in enumerate(("ids", "owners", "labels"))},
            "dim": pa.array([dim], pa.int32()), "counts": pa.array([np.bincount(places, minlength=dim).astype("<i4").tobytes()], pa.binary()),
            "rows": pa.array([at[by_place].astype("<i4").tobytes()], pa.binary()), "values": pa.array([values[by_place].astype("<f4").tobytes()], pa.binary()),
        })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        step = min(size, CORPUS_BLOCK)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                for rows, dim, at, places, values in components_of(embed, batch.column(3).to_pylist()):
                    parts = waiting.setdefault(dim, [])
                    if sum(len(part[0]) for part in parts) + len(rows) > size:
                        yield block(waiting.pop(dim))
                        parts = waiting.setdefault(dim, [])
                    parts.append((*(batch.column(n).take(pa.array(rows)) for n in range(3)), at, places, values, dim))
        for parts in waiting.values():
            yield block(parts)

    tied = [(F.lit(None) if c is None else c).cast("string").alias(name) for name, c in (("owner", owner), ("label", label))]
    given = frame.select(F.col(id_col).alias("key"), *tied, text.alias("text"))
    return given.mapInArrow(pack, f"ids array<{id_type.simpleString()}>, owners array<string>, labels array<string>, dim int, counts binary, rows binary, values binary")


def top_k_texts(rows: DataFrame, wanted: DataFrame, k: int, apart: bool = False, kinds: tuple[bool, ...] = (False,)) -> DataFrame:
    """Batch search as :func:`top_k` by inner product among blocks of texts (:func:`text_blocks`), a query's own id included: query_id, id, score, same, rank.

    ``apart`` leaves out rows of the query's owner, and those where one is null. For each of ``kinds`` there are the k best: of all rows, or (true, the column ``same``) of those with the
    query's label. Rows are left out before they are ranked, so that k are found wherever there are k. Scores are rounded to ``PLACES`` before they are ranked, so that equal ones are equal in
    every block.
    """
    wanted = wanted.withColumn("block", F.monotonically_increasing_id())
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    met = rows.crossJoin(wanted.withColumnsRenamed({c: f"q_{c}" for c in wanted.columns}))  # a stated query set against all rows, in blocks
    id_type, query_type = (met.schema[c].dataType.elementType for c in ("ids", "q_ids"))
    whole = pa.schema({"query_id": to_arrow_type(query_type), "id": to_arrow_type(id_type), "score": pa.float64()}.items())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, bool], _Best] = {}
        number, block = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: c[at] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if row["dim"] != row["q_dim"]:
                    continue
                if row["number"] != number:
                    number, block = row["number"], _TextBlock(row, "")
                keys = {kind: (row["q_block"].as_py(), kind) for kind in kinds}
                for key in keys.values():
                    if key not in kept:
                        kept[key] = _Best(k, whole, row["q_ids"].values, 0)
                text_hits(block, _TextBlock(row, "q_"), k, apart, {kind: kept[key] for kind, key in keys.items()})
        for key in list(kept):
            hits = kept.pop(key).hits()
            yield from hits.append_column("same", pa.array(np.full(len(hits), key[1]))).to_batches(max_chunksize=1 << 16)

    found = met.mapInArrow(search, f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double, same boolean")
    order = Window.partitionBy("query_id", "same").orderBy(F.col("score").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _TextBlock:
    """A block of texts as its task reads it: of each place the rows that hold it and their values, and the owners and labels by number."""

    def __init__(self, row: dict[str, pa.Scalar], prefix: str):
        self.ids, self.owners, self.labels = (row[prefix + name].values.take(pa.array(np.arange(len(row[prefix + name].values)))) for name in ("ids", "owners", "labels"))
        self.counts = np.frombuffer(row[prefix + "counts"].as_py(), "<i4").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.rows = np.frombuffer(row[prefix + "rows"].as_py(), "<i4").astype(np.int64)
        self.values = np.frombuffer(row[prefix + "values"].as_py(), "<f4").astype(np.float64)
        self.names = [column.dictionary_encode() for column in (self.owners, self.labels)]
        self.owner, self.label = (named.indices.fill_null(-1).to_numpy(zero_copy_only=False) for named in self.names)

    def numbers(self, which: int, of: pa.Array) -> np.ndarray:
        """The numbers that this block gives to owners (0) or labels (1) of another: -1 for null, -2 for one that it lacks."""
        found = pc.index_in(of, value_set=self.names[which].dictionary).fill_null(-2)
        return np.where(of.is_null().to_numpy(zero_copy_only=False), -1, found.to_numpy(zero_copy_only=False))

    def dense(self, places: np.ndarray) -> np.ndarray:
        """The components at ``places`` as a matrix, a row for each text."""
        out = np.zeros((len(places), len(self.ids)))
        for n, place in enumerate(places):
            out[n, self.rows[self.begins[place] : self.ends[place]]] = self.values[self.begins[place] : self.ends[place]]
        return out


def text_hits(block: _TextBlock, asked: _TextBlock, k: int, apart: bool, best: dict[bool, _Best]) -> None:
    """Adds the k best rows of a block for each query of another: places that many of both hold are one matrix product, the others are added row by row."""
    n, m = len(block.ids), len(asked.ids)
    work = block.counts * asked.counts
    order = np.argsort(work, kind="stable")
    light = np.zeros(len(work), bool)
    light[order[(np.cumsum(work[order]) <= SCATTERED * m) & (work[order] * DEARER <= n * m)]] = True
    heavy = np.flatnonzero(~light & (work > 0))
    left, right = block.dense(heavy), asked.dense(heavy)
    places = np.repeat(np.arange(len(asked.counts)), asked.counts)
    mine = np.flatnonzero(light[places] & (block.counts[places] > 0))
    mine = mine[np.argsort(asked.rows[mine], kind="stable")]
    until = np.searchsorted(asked.rows[mine], np.arange(m + 1))
    owner, label = block.numbers(0, asked.owners), block.numbers(1, asked.labels)
    found: dict[bool, list[tuple[int, np.ndarray, np.ndarray]]] = {kind: [] for kind in best}
    room = np.empty((STEP, n))
    for start in range(0, m, STEP):
        products = np.matmul(right[:, start : start + STEP].T, left, out=room[: min(STEP, m - start)])
        for q in range(start, min(start + STEP, m)):
            scores = products[q - start]
            terms = mine[until[q] : until[q + 1]]
            if len(terms):
                spans = [slice(block.begins[p], block.ends[p]) for p in places[terms]]
                scores += np.bincount(np.concatenate([block.rows[s] for s in spans]), np.concatenate([block.values[s] * x for s, x in zip(spans, asked.values[terms], strict=True)]), n)
            floor = min(held.floor[q] for held in best.values()) - 10.0**-PLACES
            at = np.flatnonzero(scores >= floor)
            if apart:
                at = at[(block.owner[at] >= 0) & (block.owner[at] != owner[q])] if owner[q] != -1 else at[:0]
            for kind in best:
                mark = at[(block.label[at] == label[q]) & (label[q] >= 0)] if kind else at
                near = scores[mark]
                if len(mark) > k:
                    reached = near >= np.partition(near, len(near) - k)[len(near) - k] - 10.0**-PLACES
                    mark, near = mark[reached], near[reached]
                near = np.round(near, PLACES)
                first = np.argsort(-near, kind="stable")[:k]  # rows stand by id
                found[kind].append((q, mark[first], near[first]))
    for kind, hits in found.items():
        which = np.repeat([q for q, _, _ in hits], [len(rows) for _, rows, _ in hits])
        rows = np.concatenate([rows for _, rows, _ in hits])
        best[kind].add((which, pa.table({"query_id": asked.ids.take(pa.array(which)), "id": block.ids.take(pa.array(rows)), "score": np.concatenate([near for _, _, near in hits])})))


def block_search(met: DataFrame, k: int, metric: str = "ip", threshold: float | None = None, same: bool = False, drop_self: bool = True) -> DataFrame:
    """query_id, id, score: the k best of each query among the pairs of blocks that a task holds.

    With ``q_block``, a number of the block of queries, each block's candidates are kept and merged by themselves, and what is
    worse than a query's k is no candidate; without, a query may stand in many blocks and all are merged together.
    """
    id_type, query_type = (met.schema[c].dataType.elementType for c in ("ids", "q_ids"))
    whole = pa.schema({"query_id": to_arrow_type(query_type), "id": to_arrow_type(id_type), "score": pa.float64()}.items())
    apart = "q_block" in met.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Best] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: c[at] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                key = row["q_block"].as_py() if apart else 0
                if key not in kept:
                    kept[key] = _Best(k, whole, row["q_ids"].values if apart else None)
                best = kept[key]
                best.add(block_hits(row, k, metric, threshold, same, drop_self, best.floor))
        for key in list(kept):
            yield from kept.pop(key).hits().to_batches(max_chunksize=1 << 16)

    return met.mapInArrow(search, f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double")


class _Best:
    """The k best candidates of each query; those of one block of queries (``ids``) by their place in it."""

    def __init__(self, k: int, whole: pa.Schema, ids: pa.Array | None, least: int | None = None):
        self.k, self.whole, self.least = k, whole, least
        self.ids = None if ids is None else ids.take(pa.array(np.arange(len(ids))))  # a copy: the batch goes
        self.floor = None if ids is None else np.full(len(ids), -np.inf)
        self.schema = whole if ids is None else whole.set(0, pa.field("query_id", pa.int64()))
        self.best, self.waiting, self.rows = self.schema.empty_table(), [], 0

    def add(self, found: tuple[np.ndarray, pa.Table] | None) -> None:
        if found is None:
            return
        which, table = found
        table = table if self.ids is None else table.set_column(0, "query_id", pa.array(which.astype(np.int64)))
        self.waiting.append(table.cast(self.schema))
        self.rows += table.num_rows
        if self.rows > (max(MERGE_ROWS, self.best.num_rows) if self.least is None else self.least):
            self.merge()

    def merge(self) -> None:
        self.best = best_hits(pa.concat_tables([self.best, *self.waiting]), self.k)
        self.waiting, self.rows = [], 0
        if self.ids is not None:
            counts = np.bincount(self.best["query_id"].to_numpy(), minlength=len(self.ids))
            full = counts == self.k
            self.floor[full] = self.best["score"].to_numpy()[np.cumsum(counts)[full] - 1]

    def hits(self) -> pa.Table:
        self.merge()
        return self.best if self.ids is None else self.best.set_column(0, "query_id", self.ids.take(self.best["query_id"].combine_chunks())).cast(self.whole)


def block_hits(row: dict[str, pa.Scalar], k: int, metric: str, threshold: float | None, same: bool, drop_self: bool, floor: np.ndarray | None = None) -> tuple[np.ndarray, pa.Table] | None:
    """A block of queries among a block of rows: the places of the queries, and query_id, id, score, of the k best of each with all that equal the last of them.

    ``floor`` has a score for each query that hits reach.
    """
    ids, q_ids, dim = row["ids"].values, row["q_ids"].values, row["dim"].as_py()
    if dim != row["q_dim"].as_py():
        return None
    scores = block_scores(row, metric)
    allowed = ~np.isnan(scores)
    if floor is not None:
        allowed &= scores >= floor[None, :]
    if drop_self:
        allowed &= ~_equal(ids, q_ids)
    if same:
        allowed &= _equal(row["labels"].values, row["q_labels"].values)
    if metric == "cosine" and threshold is not None:
        allowed &= scores > threshold
    if len(ids) > k and (allowed.sum(axis=0) > k).any():
        ranked = np.where(allowed, scores, -np.inf)
        allowed &= ranked >= np.partition(ranked, len(ids) - k, axis=0)[len(ids) - k][None, :]
    at, which = np.nonzero(allowed)
    return which, pa.table({"query_id": q_ids.take(pa.array(which)), "id": ids.take(pa.array(at)), "score": scores[at, which]})


def block_scores(row: dict[str, pa.Scalar], metric: str) -> np.ndarray:
    """Scores of a block's rows (down) and queries (across); cosine with a zero vector is not a number."""
    dim = row["dim"].as_py()
    one, two = (np.frombuffer(row[name].as_buffer(), "<f8").reshape(len(row[key].values), dim) for name, key in (("vectors", "ids"), ("q_vectors", "q_ids")))
    scores = one @ two.T
    if metric != "cosine":
        return scores
    below = np.linalg.norm(one, axis=1)[:, None] * np.linalg.norm(two, axis=1)[None, :]
    return np.divide(scores, below, out=np.full_like(scores, np.nan), where=below > 0)


def _equal(down: pa.Array, across: pa.Array) -> np.ndarray:
    """Which values of two arrays are equal; null equals nothing. Values of different types are compared as texts."""
    if down.type != across.type:
        down, across = down.cast(pa.string()), across.cast(pa.string())
    codes = pa.concat_arrays([down, across]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    one, two = codes[: len(down)], codes[len(down) :]
    return (one[:, None] == two[None, :]) & (one >= 0)[:, None]


def best_hits(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, ties by id (null first)."""
    order = pc.sort_indices(found, sort_keys=[("query_id", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
    ranked = found.take(order).combine_chunks()
    codes = ranked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.diff(codes, prepend=-1))
    place = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
    return ranked.filter(pa.array(place < k))


def best_per_label(corpus: DataFrame, queries: DataFrame, label: str, id_col: str = "id", vector_col: str = "embedding", query_col: str = "query_id") -> DataFrame:
    """query, label, best: the highest cosine of each query among the rows of each label, its own id left out.

    In blocks as :func:`top_k`; a task keeps one number for each query and label it has seen (``LABEL_CELLS`` at most, then it passes them on), and these are shuffled. A null
    label is a label.
    """
    rows = vector_blocks(corpus, id_col, vector_col, F.col(label), CORPUS_BLOCK)
    wanted = vector_blocks(queries, query_col, vector_col, F.lit(""), QUERY_BLOCK).withColumn("block", F.monotonically_increasing_id())
    query_type, label_type = queries.schema[query_col].dataType, corpus.schema[label].dataType
    whole = pa.schema({"query_id": to_arrow_type(query_type), "label": pa.string(), "best": pa.float64()}.items())

    def told(kept: dict[int, tuple[pa.Array, dict, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for key in list(kept):
            q_ids, places, top = kept.pop(key)
            which, query = np.nonzero(top > -np.inf)
            named = pa.array(list(places), pa.string()).take(pa.array(which))
            yield from pa.table({"query_id": q_ids.take(pa.array(query)), "label": named, "best": top[which, query]}).cast(whole).to_batches(max_chunksize=1 << 16)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[pa.Array, dict, np.ndarray]] = {}  # of a block of queries its ids, the labels seen and their best scores
        cells = 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: c[at] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if row["dim"] != row["q_dim"]:
                    continue
                scores = block_scores(row, "cosine")
                scores = np.where(np.isnan(scores) | _equal(row["ids"].values, row["q_ids"].values), -np.inf, scores)
                labels = row["labels"].values.dictionary_encode(null_encoding="encode")
                codes = labels.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                begins = np.flatnonzero(np.diff(codes[order], prepend=-1))
                found = np.maximum.reduceat(scores[order], begins, axis=0)
                key, asked = row["q_block"].as_py(), row["q_ids"].values
                if key not in kept:
                    kept[key] = (asked.take(pa.array(np.arange(len(asked)))), {}, np.empty((0, len(asked))))
                q_ids, places, top = kept[key]
                at_label = [places.setdefault(name, len(places)) for name in labels.dictionary.take(pa.array(codes[order][begins])).to_pylist()]
                if more := len(places) - len(top):
                    top = np.concatenate([top, np.full((more, len(q_ids)), -np.inf)])
                    cells += more * len(q_ids)
                top[at_label] = np.maximum(top[at_label], found)
                kept[key] = (q_ids, places, top)
                if cells > LABEL_CELLS:
                    cells = 0
                    yield from told(kept)
        yield from told(kept)

    met = rows.crossJoin(wanted.withColumnsRenamed({c: f"q_{c}" for c in wanted.columns}))
    scored = met.mapInArrow(search, f"query_id {query_type.simpleString()}, label string, best double")
    return scored.groupBy("query_id", F.col("label").cast(label_type).alias(label)).agg(F.max("best").alias("best"))


def vector_blocks(frame: DataFrame, id_col: str, vector_col: str, label: Column, size: int, key: str | None = None) -> DataFrame:
    """Rows with a vector in blocks of at most ``size``: ids, dim, vectors (doubles, one after the other), labels. No shuffle.

    A block holds vectors of one length, and with ``key`` (an integer column) rows of one key, which it then carries;
    rows that stand together come into one block.
    """
    id_type = frame.schema[id_col].dataType
    group = F.col(key).cast("long") if key else F.lit(0).cast("long")
    given = frame.where(F.col(vector_col).isNotNull()).select(
        group.alias("group"), F.size(vector_col).alias("dim"), F.col(id_col).alias("key"), F.col(vector_col).cast("array<double>").alias("vector"), label.cast("string").alias("label")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, dims = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
            order = np.lexsort((dims, groups))
            new = np.flatnonzero((np.diff(groups[order], prepend=groups[order][:1] - 1) != 0) | (np.diff(dims[order], prepend=dims[order][:1] - 1) != 0))
            for begin, end in zip(new, np.append(new[1:], len(order)), strict=True):
                for start in range(begin, end, size):
                    part = batch.take(pa.array(order[start : min(start + size, end)]))
                    flat = part.column(3).flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_pydict({
                        "group": pa.array([groups[order[start]]], pa.int64()), "ids": pa.array([part.column(2).to_pylist()], pa.list_(part.column(2).type)), "dim": pa.array([dims[order[start]]], pa.int32()),
                        "vectors": pa.array([flat.astype("<f8").tobytes()], pa.binary()), "labels": pa.array([part.column(4).to_pylist()], pa.list_(pa.string())),
                    })

    blocks = given.mapInArrow(pack, f"group bigint, ids array<{id_type.simpleString()}>, dim int, vectors binary, labels array<string>")
    return blocks.withColumnRenamed("group", key) if key else blocks.drop("group")


EMPTY_UNIT = {"id": -1, "text": ""}


def _places(units: DataFrame, id_col: str, keys: tuple[str, ...], index: str, text_col: str) -> DataFrame:
    """One unit (the smallest id) for each place."""
    return units.groupBy(*keys, F.col(index).alias("__at")).agg(F.min(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).alias("unit"))


def context(units: DataFrame, hits: DataFrame, offset: int, id_col: str = "id", keys: tuple[str, ...] = ("doc_id", "section_title"),
            index: str = "sentence_index", text_col: str = "text") -> DataFrame:
    """For each hit (a row of ``units`` by id): the unit ``offset`` places on, by index and not by neighbourhood.

    Gaps and ends give the empty unit (id -1, empty text); of duplicates the smallest id counts.
    """
    own = units.select(F.col(id_col).alias("hit_id"), *[F.col(k) for k in keys], (F.col(index) + offset).alias("__at"))
    wanted = own.join(hits.select(F.col(id_col).alias("hit_id")).distinct(), "hit_id", "left_semi")
    return wanted.join(_places(units, id_col, keys, index, text_col), [*keys, "__at"], "left").select(
        "hit_id", F.coalesce("unit.id", F.lit(EMPTY_UNIT["id"]).cast("long")).alias("unit_id"), F.coalesce("unit.text", F.lit(EMPTY_UNIT["text"])).alias("unit_text")
    )


def with_context(units: DataFrame, hits: DataFrame, offset: int = 0, id_col: str = "id", keys: tuple[str, ...] = ("doc_id", "section_title"),
                 index: str = "sentence_index", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """hit_id, target (``offset`` places on) and the units before and after the target.

    A hit asks for three places, which meet the units once; a target that is not there has no neighbours. With ``carry`` each row of
    ``hits`` gets its own row with these columns of it (the query, the similarity, the rank); without, each id one.
    """
    asked = units.join(hits.select(F.col(id_col)).distinct(), id_col, "left_semi").select(
        F.col(id_col).alias("hit_id"), *[F.col(k) for k in keys], F.explode(F.array(*[F.lit(step) for step in (-1, 0, 1)])).alias("step"), F.col(index).alias("__own")
    ).withColumn("__at", F.col("__own") + offset + F.col("step"))
    met = asked.join(_places(units, id_col, keys, index, text_col), [*keys, "__at"], "left")
    found = met.groupBy("hit_id").agg(*[F.max(F.when(F.col("step") == step, F.col("unit"))).alias(name) for name, step in (("previous", -1), ("target", 0), ("next", 1))])
    there = F.col("target").isNotNull()
    cells = []
    for name in ("target", "previous", "next"):
        unit = F.when(there, F.col(name))
        cells += [F.coalesce(unit["id"], F.lit(EMPTY_UNIT["id"]).cast("long")).alias(f"{name}_id"), F.coalesce(unit["text"], F.lit(EMPTY_UNIT["text"])).alias(f"{name}_text")]
    whole = found.select("hit_id", *cells)
    return whole.join(hits.select(F.col(id_col).alias("hit_id"), *carry), "hit_id") if carry else whole


def score_list(score: Column, rank: Column) -> Column:
    """An aggregate: scores in rank order with four decimals, joined by ", "."""
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.format_string("%.4f", score).alias("s"))))
    return F.array_join(F.transform(ordered, lambda x: x["s"]), ", ")


def wide_report(hits: DataFrame, slots: int = 10, query: str = "query_id") -> DataFrame:
    """One row a query: scores, and text and citation of each slot, padded with "" and "N/A"."""
    cells = []
    for slot in range(1, slots + 1):
        at = F.col("rank") == slot
        cells += [
            F.coalesce(F.max(F.when(at, tx.sanitize_cell(F.col("text")))), F.lit("")).alias(f"suggestion_{slot}_text"),
            F.coalesce(F.max(F.when(at, tx.sanitize_cell(F.col("citation")))), F.lit("N/A")).alias(f"suggestion_{slot}_citation"),
        ]
    top = F.max(F.when(F.col("rank") == 1, F.concat("text", F.lit(" ("), "citation", F.lit(")")))).alias("top_suggestion")
    return hits.groupBy(query).agg(score_list(F.col("score"), F.col("rank")).alias("scores"), top, *cells)
