"""Retrieval as one call: texts in, hits with their neighbours and similarities out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.models import Embedder, embedded
from casemill.operators import retrieval, vector_index


def retrieve(texts: DataFrame, units: DataFrame, embed: Embedder, k: int = 10, label: str | None = None, threshold: float | None = None, offset: int = 0,
             index: vector_index.VectorIndex | None = None) -> DataFrame:
    """query_id, rank, similarity, hit_id, and the target and the units before and after it, for every text.

    ``texts`` has query_id and text, ``units`` id, doc_id, section_title, sentence_index, text and, for a label filter, label. Texts and units
    are embedded in batches, or the units come from ``index``; the k nearest units by cosine (to nine places, ties to the smaller id)
    above ``threshold`` are hits, and ``offset`` moves the target from the hit to a unit that many places on. The
    label filter holds before the search; with an index, which knows no labels, it follows an oversample of 30 k. Blank texts have
    zero vectors and no hits; gaps and ends give empty units.
    """
    asked = embedded(texts.select("query_id", "text"), F.col("text"), embed).select("query_id", "embedding")
    places = units.select("id", "doc_id", "section_title", "sentence_index", "text")
    if index is None:
        wanted = units.where(F.col("label") == label) if label is not None else units
        corpus = embedded(wanted.select("id", "text"), F.col("text"), embed).select("id", "embedding")
        found = retrieval.top_k(corpus, asked, k, "cosine", threshold, drop_self=False)
    else:
        found = vector_index.search(index, asked, k if label is None else 30 * k, drop_self=False)
        if threshold is not None:
            found = found.where(F.col("score") > threshold)
        if label is not None:
            found = found.join(units.where(F.col("label") == label).select("id"), "id", "left_semi")
    ranked = retrieval.rank_hits(found.drop("rank").withColumn("score", F.round("score", 9)), k).withColumnRenamed("score", "similarity")
    return retrieval.with_context(places, ranked, offset, carry=("query_id", "rank", "similarity"))
