"""Retrieval: vector search, context, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import text as tx
from casemill.functions import vector as vx
from casemill.operators import answers, greedy, retrieval, service, table_functions, vector_index
from casemill.plans.registry import Registry
from casemill.plans.tables import table
from casemill.scratch import fresh
from casemill.sources import tables

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_DOT = "list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_NORM = "sqrt(list_inner_product(CAST({0}.embedding AS DOUBLE[]), CAST({0}.embedding AS DOUBLE[])))"
_COSINE = f"{_DOT} / ({_NORM.format('c')} * {_NORM.format('q')})"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(corpus: DataFrame) -> DataFrame:
    """Every twentieth id: a set that grows with the table."""
    return corpus.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")


def _single_sql(score: str, k: int, above: str = "") -> str:
    return f"""SELECT q.vec_id AS query_id, c.vec_id AS id, round({score}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, c.vec_id) AS INTEGER) AS rank
        FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 {above} QUALIFY rank <= {k}"""


@register(_single_sql(_DOT, 10))
def knn_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all rows, its own included."""
    corpus = _vectors(spark, sf_dir)
    return retrieval.top_k(corpus, _queries(corpus), 10, drop_self=False).withColumn("score", F.round("score", 6))


@register(_single_sql(_COSINE, 20, f"AND {_COSINE} > 0.2"))
def knn_cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    return retrieval.top_k(corpus, _queries(corpus), 20, "cosine", 0.2, drop_self=False).withColumn("score", F.round("score", 6))


def _ranked_sql(extra: str = "", k: int = 10) -> str:
    return f"""SELECT q.vec_id AS query_id, c.vec_id AS id, c.label AS label, q.label AS query_label, {_DOT} AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, c.vec_id) AS rank
        FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id {extra} QUALIFY rank <= {k}"""


@register(f"SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_ranked_sql()})")
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    return retrieval.top_k(corpus, _queries(corpus), 10).withColumn("score", F.round("score", 6))


def _oversampled(corpus: DataFrame, candidates: int) -> DataFrame:
    """Candidates of each query with their own and the query's label."""
    hits = retrieval.top_k(corpus, _queries(corpus), candidates)
    labels = _queries(corpus).select("query_id", F.col("label").alias("query_label"))
    return hits.join(corpus.select("id", "label"), "id").join(labels, "query_id")


@register(f"""SELECT query_id, id, score, CAST(place AS INTEGER) AS rank FROM (
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place
    FROM ({_ranked_sql(k=300)}) WHERE label = query_label) WHERE place <= 10""")
def knn_label_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label filter after an oversample of 300: fewer than ten may remain."""
    same = _oversampled(_vectors(spark, sf_dir), 300).where("label = query_label")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return same.withColumn("rank", place).where("rank <= 10").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register(f"SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_ranked_sql('AND c.label = q.label')})")
def knn_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    return retrieval.top_k(corpus, _queries(corpus), 10, same="label").withColumn("score", F.round("score", 6))


@register(f"""SELECT c.vec_id AS id, round({_DOT} / ({_NORM.format('c')} * {_NORM.format('q')} + 1e-9), 6) AS score, 0.0 AS zero_score
    FROM embeddings c JOIN embeddings q ON q.vec_id = c.vec_id + 1""")
def cosine_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one, by the cosine that can't divide by zero."""
    corpus = _vectors(spark, sf_dir)
    following = corpus.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    zero = vx.safe_score(vx.cosine(F.col("embedding"), vx.zero_vector(64)))
    return corpus.join(following, "id").select("id", F.round(vx.cosine(F.col("embedding"), F.col("next"), 1e-9), 6).alias("score"), zero.alias("zero_score"))


@register(f"SELECT q.vec_id AS query_id, c.label, round(greatest(max({_COSINE}), 0.0), 4) AS best FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL")
def best_match_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    best = retrieval.best_per_label(corpus, _queries(corpus), "label")
    return best.select("query_id", "label", F.round(F.greatest("best", F.lit(0.0)), 4).alias("best"))


def _units(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(F.length(tx.or_empty(F.col("text"))) >= least)
    return rows.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), F.lit("Main").alias("section_title"),
        F.col("turn").alias("sentence_index"), "text",
    )


def _context_sql(offset: int, least: int) -> str:
    return f"""WITH u AS (SELECT conv_id * 1000000 + turn AS id, conv_id AS doc_id, turn AS i, text FROM conversations WHERE length(text) >= {least}),
    t AS (SELECT h.id AS hit_id, coalesce(u.id, -1) AS target_id, coalesce(u.text, '') AS target_text, u.doc_id, u.i
        FROM u h LEFT JOIN u ON u.doc_id = h.doc_id AND u.i = h.i + {offset})
    SELECT hit_id, target_id, target_text, coalesce(p.id, -1) AS previous_id, coalesce(p.text, '') AS previous_text,
        coalesce(n.id, -1) AS next_id, coalesce(n.text, '') AS next_text
    FROM t LEFT JOIN u p ON p.doc_id = t.doc_id AND p.i = t.i - 1 LEFT JOIN u n ON n.doc_id = t.doc_id AND n.i = t.i + 1"""


@register(_context_sql(0, 0))
def context_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    return retrieval.with_context(units, units.select("id"))


@register(_context_sql(2, 0))
def context_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    return retrieval.with_context(units, units.select("id"), offset=2)


@register(_context_sql(0, 50))
def context_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir, least=50)
    return retrieval.with_context(units, units.select("id"))


def _report_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    hits = retrieval.top_k(corpus, _queries(corpus), 10, same="label")
    return hits.withColumns({"text": F.concat(F.lit("unit\t"), F.col("id").cast("string")), "citation": F.concat(F.lit("case "), F.col("id").cast("string"))})


_CELLS = ", ".join(f"coalesce(max(CASE WHEN rank = {i} THEN 'unit ' || id END), '') AS suggestion_{i}_text, coalesce(max(CASE WHEN rank = {i} THEN 'case ' || id END), 'N/A') AS suggestion_{i}_citation" for i in range(1, 11))
_SCORES = "string_agg(printf('%.4f', score), ', ' ORDER BY rank) AS scores"


@register(f"""SELECT query_id, {_SCORES}, max(CASE WHEN rank = 1 THEN 'unit' || chr(9) || id || ' (case ' || id || ')' END) AS top_suggestion, {_CELLS}
    FROM ({_ranked_sql('AND c.label = q.label')}) GROUP BY query_id""")
def suggestion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.wide_report(_report_hits(spark, sf_dir))


@register(f"SELECT query_id, {_SCORES} FROM ({_ranked_sql()}) GROUP BY query_id")
def score_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    hits = retrieval.top_k(corpus, _queries(corpus), 10)
    return hits.groupBy("query_id").agg(retrieval.score_list(F.col("score"), F.col("rank")).alias("scores"))


@register(f"""WITH h AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, c.vec_id) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND {_COSINE} > 0.35 QUALIFY rank <= 10)
    SELECT query_id, count(*) AS hits, CASE WHEN count(*) = 10 THEN {_SCORES.removesuffix(' AS scores')} END AS scores FROM h GROUP BY query_id""")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are filled only where all ten hits are there."""
    corpus = _vectors(spark, sf_dir)
    hits = retrieval.top_k(corpus, _queries(corpus), 10, "cosine", 0.35)
    full = F.count("score") == 10
    return hits.groupBy("query_id").agg(
        F.count("score").alias("hits"), F.when(full, retrieval.score_list(F.col("score"), F.col("rank"))).alias("scores")
    )


@register(f"""SELECT query_id, bool_or(id % 50 = query_id % 50) AS any_same_case FROM ({_ranked_sql()}) GROUP BY query_id""")
def same_case_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    hits = retrieval.top_k(corpus, _queries(corpus), 10)
    return hits.groupBy("query_id").agg(F.bool_or(F.col("id") % 50 == F.col("query_id") % 50).alias("any_same_case"))


@register(f"SELECT query_id, id, pct, CASE WHEN pct <= 20 THEN 'very-low' WHEN pct <= 40 THEN 'low' WHEN pct <= 60 THEN 'moderate' WHEN pct <= 80 THEN 'high' ELSE 'very-high' END AS ui_band, CASE WHEN score >= 0.75 THEN 'top' WHEN score >= 0.65 THEN 'second' WHEN score >= 0.55 THEN 'third' ELSE 'bottom' END AS eval_band FROM (SELECT *, CAST(floor(round(score, 6) * 100 + 0.5) AS INTEGER) AS pct FROM ({_ranked_sql(k=100)}))")
def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    hits = retrieval.top_k(corpus, _queries(corpus), 100)
    scored = hits.withColumn("pct", tx.percent(F.round("score", 6)))
    return scored.select("query_id", "id", "pct", tx.similarity_band(F.col("pct")).alias("ui_band"), tx.score_band(F.col("score")).alias("eval_band"))


@register()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of each source, in the order of their ids, through the greedy near-duplicate filter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", tx.core_text(F.col("text")).alias("core"))
    return greedy.keep_distinct_hits(docs, 10, "source", candidate_limit=None, rank="doc_id").select("doc_id", "source")


def _built(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    corpus = _vectors(spark, sf_dir)
    return vector_index.build(corpus, fresh(spark, "index")), _queries(corpus)


@register()
def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every twentieth id by the inverted-file index, with as many lists as it has set itself."""
    index, queries = _built(spark, sf_dir)
    return vector_index.search(index, queries, 10).withColumn("score", F.round("score", 6))


@register(f"""SELECT q.vec_id AS query_id, c.vec_id AS id, round({_COSINE}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, c.vec_id) AS INTEGER) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 10""")
def knn_index_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index with all lists probed: what it holds is whole, and its ranking exact."""
    index, queries = _built(spark, sf_dir)
    return vector_index.search(index, queries, 10, probes=len(index.centroids)).withColumn("score", F.round("score", 6))


@register(f"SELECT query_id, id, label, round(score, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM ({_ranked_sql()})")
def match_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch search as a table function that SQL calls laterally for every twentieth id."""
    _vectors(spark, sf_dir).createOrReplaceTempView("casemill_units")
    table_functions.register_match(spark, "match_units", "casemill_units", "ip")
    return spark.sql("""SELECT q.id AS query_id, m.id, m.label, round(m.similarity, 6) AS similarity, m.rank
        FROM (SELECT * FROM casemill_units WHERE id % 20 = 0) q, LATERAL match_units(CAST(q.embedding AS ARRAY<DOUBLE>), NULL, 10, q.id) m""")


_LETTERS = "list_transform(range(97, 123), lambda i: CAST(length({0}.text) - length(replace({0}.text, chr(CAST(i AS INTEGER)), '')) AS DOUBLE))"


def letter_counts(texts: pd.Series) -> pd.Series:
    """An embedder that needs no model: how often a text holds each letter from a to z."""
    return pd.Series([[float((t or "").count(chr(c))) for c in range(97, 123)] for t in texts])


@register(f"""WITH u AS (SELECT conv_id * 1000000 + turn AS id, conv_id, turn, role, text, {_LETTERS.format('conversations')} AS v FROM conversations),
    q AS (SELECT item_id, {_LETTERS.format('benchmark')} AS v FROM benchmark),
    h AS (SELECT q.item_id, u.*, list_cosine_similarity(u.v, q.v) AS s FROM q, u WHERE u.role = 'assistant' AND list_cosine_similarity(u.v, q.v) > 0.5),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, id) AS INTEGER) AS rank FROM h QUALIFY rank <= 5)
    SELECT r.item_id AS query_id, r.id AS hit_id, r.rank, round(r.s, 6) AS similarity, r.text AS target, coalesce(p.text, '') AS previous, coalesce(n.text, '') AS next
    FROM r LEFT JOIN u p ON p.conv_id = r.conv_id AND p.turn = r.turn - 1 LEFT JOIN u n ON n.conv_id = r.conv_id AND n.turn = r.turn + 1""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in, hits out in one call: the benchmark's items against the assistants' turns, with neighbours and similarities."""
    units = _units(spark, sf_dir).join(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("role").alias("label")), "id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = service.retrieve(asked, units, letter_counts, 5, label="assistant", threshold=0.5)
    return found.select("query_id", "hit_id", "rank", F.round("similarity", 6).alias("similarity"), F.col("target_text").alias("target"), F.col("previous_text").alias("previous"), F.col("next_text").alias("next"))


@register("SELECT conv_id, turn, CAST(length(substr(text, 1, 60 + turn % 3)) AS VARCHAR) AS answer FROM conversations")
def answers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's answers about every turn; equal prompts are asked once."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("substr(text, 1, int(60 + turn % 3))").alias("prompt"))
    return answers.answered_once(rows, "prompt", lambda prompt: str(len(prompt)), fresh(spark, "answers")).select("conv_id", "turn", "answer")


@register("""SELECT doc_id, translate(source, chr(9), ' ') AS source, md5(translate(text, chr(9) || chr(13), '  ')) AS digest FROM documents""")
def records_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as records whose fields hold newlines, and read back by ranges of 64 KB."""
    cell = lambda c: F.translate(F.col(c), "\t\r", "  ")
    line = F.concat(F.lit("\nUKSC\t"), F.col("doc_id").cast("string"), F.lit("\t"), cell("source"), F.lit("\t"), cell("text"), F.lit("\tx\ty"))
    folder = fresh(spark, "records")
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(folder)
    rows = tables.read_records(spark, folder, range_bytes=64 << 10)
    return rows.select(F.col("c1").cast("long").alias("doc_id"), F.col("c2").alias("source"), F.md5("c3").alias("digest"))
