"""Reports of suggestions whose cells were cut off: the whole sentence from the cited document, written back in place of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import judgments as jd
from casemill.functions import text as tx
from casemill.operators.cases import matched_documents, repaired_texts
from casemill.scratch import written
from casemill.sources.tables import write_report

#: Columns of a report: the first suggestion with its citation in brackets, and the others' texts and citations (fixed values).
TOP, TOP_CITATION = "Top Suggestion", "Suggestion 1 Citation"
SLOTS = tuple((f"Suggestion {n} Text", f"Suggestion {n} Citation") for n in range(2, 11))


def cut_cells(report: DataFrame, keys: list[str], top: tuple[str, str] | None = (TOP, TOP_CITATION), slots: tuple[tuple[str, str], ...] = SLOTS) -> DataFrame:
    """keys, slot, cell, citation, whole: the cells that end as cut-off ones do and name their document; a cell's slot is its column.

    The citation of the top cell is the one in brackets at its end, else its column's; ``whole`` tells that it is written back
    with the text. Slots whose columns the report lacks are passed over, as are null cells and blank citations.
    """
    there = set(report.columns)
    text = lambda c: tx.or_empty(F.col(f"`{c}`"))
    found = []
    if top is not None and set(top) <= there:
        parts = jd.suggested(text(top[0]))
        citation = F.coalesce(F.nullif(parts["citation"], F.lit("")), text(top[1]))
        found.append((top[0], text(top[0]), parts["text"], citation, True))
    found += [(t, text(t), text(t), text(c), False) for t, c in slots if t in there and c in there]
    if not found:
        raise ValueError(f"none of the report's columns {sorted(there)} holds suggestions")
    cells = F.array(*[F.struct(F.lit(n).alias("slot"), tx.is_truncated(given).alias("cut"), cell.alias("cell"), tx.strip(c).alias("citation"), F.lit(w).alias("whole")) for n, given, cell, c, w in found])
    return report.select(*[F.col(f"`{k}`") for k in keys], F.inline(cells)).where("cut AND citation <> '' AND cell <> ''").drop("cut")


def repaired_report(report: DataFrame, sentences: DataFrame, keys: list[str], top: tuple[str, str] | None = (TOP, TOP_CITATION), slots: tuple[tuple[str, str], ...] = SLOTS) -> DataFrame:
    """``report`` with its cut-off cells made whole, and __repaired (int): how many of a row's cells changed.

    ``sentences`` has document, sentence, position and rank, the order of the documents. A citation meets its document as
    names do, and the cell its sentence within that document; cells for which there is none stay. Distinct cells are
    repaired once, however many rows hold them, and travel without their rows. ``keys`` tell rows apart;
    they may be null.
    """
    cut = written(cut_cells(report, keys, top, slots), "cut-cells")
    named = cut.select(F.col("citation").alias("name")).distinct()
    documents = sentences.groupBy("document").agg(F.min("rank").alias("rank"))
    met = written(matched_documents(named, documents), "cited-documents")
    asked = cut.join(met, F.col("citation") == F.col("name")).select("cell", "document", "citation").distinct()
    whole = repaired_texts(asked.select("cell", "document"), sentences.select("document", "sentence", "position"))
    texts = written(asked.join(whole, ["cell", "document"]).select("cell", "citation", "repaired"), "repaired-cells")
    text = F.when(F.col("whole"), F.concat("repaired", F.lit(" ("), "citation", F.lit(")"))).otherwise(F.col("repaired"))
    names = [f"__key_{n}" for n in range(len(keys))]
    changed = cut.join(texts, ["cell", "citation"]).select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], "slot", text.alias("text"))
    by_row = changed.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("slot", "text"))).alias("__cells"))  # at most a row's slots
    same = [report[f"`{k}`"].eqNullSafe(by_row[n]) for k, n in zip(keys, names, strict=True)]
    texts_of = {pair[0] for pair in ((top,) if top else ()) + slots}
    joined = report.join(by_row, same, "left")
    return joined.select(
        *[F.coalesce(F.try_element_at("__cells", F.lit(c)), report[f"`{c}`"]).alias(c) if c in texts_of else report[f"`{c}`"] for c in report.columns if c != "__repaired"],
        F.coalesce(F.size("__cells"), F.lit(0)).alias("__repaired"),
    )


def rewrite_reports(spark: SparkSession, folder: str, sentences: DataFrame, target: str, pattern: str = "*.tsv") -> DataFrame:
    """file, repaired: the tab-separated reports of a folder, repaired and written to ``target`` as its new version.

    Each report becomes the folder ``report_file=<its stem>`` with its rows in their order, quoted; the old ones are left as they are and a run that is
    repeated overwrites its own. Files of one header are read together, so reports may differ in their columns. A
    report with quoted newlines can't be split, so it is read and written by one task; its cells are repaired by all.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    head = F.split(F.decode("content", "UTF-8"), "\r?\n", 2)[0]
    headed = listed.select("path", head.alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    counts = []
    for at, group in enumerate(headed.orderBy("head").collect()):  # a row a header, and paths as Spark's own listing holds them
        rows = spark.read.csv(group["paths"], sep="\t", header=True, quote='"', escape='"', multiLine=True)
        path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
        stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
        placed = written(rows.select("*", stem.alias("report_file"), F.monotonically_increasing_id().alias("__row")), "reports")
        done = written(repaired_report(placed, sentences, ["report_file", "__row"]), "repaired-reports")
        ordered = done.repartition("report_file").sortWithinPartitions("report_file", "__row").drop("__row", "__repaired")
        write_report(ordered, target, by="report_file", mode="append" if at else "overwrite")
        counts.append(done.groupBy(F.col("report_file").alias("file")).agg(F.sum("__repaired").alias("repaired")))
    return reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "file string, repaired long")
