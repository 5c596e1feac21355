"""Text: normalisation, segmentation, extraction, scores, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import text as tx
from casemill.operators import relational
from casemill.plans.registry import Registry
from casemill.plans.tables import table
from casemill.sources.html import ENDS, OPENS, extracted_paragraphs

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def literal_rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, names)


def values_sql(rows: list[tuple], names: str) -> str:
    """The same rows for DuckDB."""

    def cell(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return str(value)

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


_COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CORE = (
    r"substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(lower(regexp_replace(trim(coalesce({0}, ''), ' ' || chr(10) || chr(9)), '^(?:\[\s*[sS]?\d+\s*\]\s*)+', '')), 1, 900),"
    r" '[\x22'']', ' ', 'g'), '[—\-–,;:]\s*', ' ', 'g'), '-\s+', '', 'g'), '\s+', ' ', 'g')), 1, 450)"
)


@register(f"SELECT doc_id, {_CORE.format('text')} AS core, lower({_COLLAPSE.format('text')}) AS normal FROM documents")
def core_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.core_text(F.col("text")).alias("core"), tx.normalize(F.col("text")).alias("normal"))


_ABBR = "{0}"
for _a in tx.ABBREVIATIONS:
    _ABBR = f"replace({_ABBR}, '{_a}', '{_a[:-2]}' || chr(1) || '{_a[-1]}')"


def _split_sql(column: str, marks: str = ".!?", protect: bool = True) -> str:
    source = _ABBR.format(column) if protect else column
    return f"string_split(regexp_replace({source}, '([{marks}])\\s+', '\\1' || chr(2), 'g'), chr(2))"


_WS = "' ' || chr(10) || chr(9) || chr(13)"
_SENTENCES = f"(SELECT doc_id, source, trim(replace(s, chr(1), '.'), {_WS}) AS sentence, pos FROM (SELECT doc_id, source, unnest({_split_sql('text')}) AS s, generate_subscripts({_split_sql('text')}, 1) AS pos FROM documents) WHERE length(trim(replace(s, chr(1), '.'), {_WS})) >= 10)"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select("doc_id", "source", F.posexplode(tx.sentences(F.col("text"))).alias("at", "sentence"))


@register(f"""SELECT doc_id, (SELECT count(*) FROM {_SENTENCES} s WHERE s.doc_id = d.doc_id) AS sentences,
    len(list_filter({_split_sql('text', protect=False)}, lambda s: length(trim(s, {_WS})) >= 10)) AS plain,
    len(list_filter({_split_sql('text', '.!?;', False)}, lambda s: trim(s, {_WS}) <> '')) AS phrases FROM documents d""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tx.sentences(text)).cast("long").alias("sentences"), F.size(tx.sentences(text, protect=False)).cast("long").alias("plain"),
        F.size(tx.phrases(text)).cast("long").alias("phrases"),
    )


@register(f"""SELECT doc_id, sentence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS sentence_index,
    CAST((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 15 AS BIGINT) AS batch FROM {_SENTENCES}""")
def sentence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.indexed(_sentences(spark, sf_dir), "doc_id", ["at"])
    index = F.col("sentence_index").cast("long")
    return rows.select("doc_id", "sentence", index.alias("sentence_index"), F.floor(index / 15).alias("batch"))


@register(f"""SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars,
    CAST(floor(avg(length(sentence))) AS BIGINT) AS mean, CAST(min(length(sentence)) AS BIGINT) AS low, CAST(max(length(sentence)) AS BIGINT) AS high,
    count(*) FILTER (length(sentence) < 50) AS short, count(*) FILTER (length(sentence) BETWEEN 50 AND 150) AS middle,
    count(*) FILTER (length(sentence) > 150) AS long FROM {_SENTENCES} GROUP BY ROLLUP (source)""")
def paragraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).withColumn("len", F.length("sentence"))
    stats = rows.rollup("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("chars"), F.floor(F.avg("len")).alias("mean"), F.min("len").cast("long").alias("low"),
        F.max("len").cast("long").alias("high"), F.count_if(F.col("len") < 50).alias("short"),
        F.count_if(F.col("len").between(50, 150)).alias("middle"), F.count_if(F.col("len") > 150).alias("long"),
    )
    return stats.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@register(f"""WITH c AS (SELECT item_id, {_CORE.format('text')} AS core FROM benchmark),
    s AS (SELECT item_id, unnest(list_filter(list_transform(generate_series(0, greatest(0, length(core) - 100), 30), lambda i: substr(core, CAST(i AS INTEGER) + 1, 100)), lambda s: length(s) >= 80)) AS shingle FROM c)
    SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM (SELECT DISTINCT * FROM s) a JOIN (SELECT DISTINCT * FROM s) b USING (shingle) WHERE a.item_id <= b.item_id GROUP BY ALL""")
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.shingles(tx.core_text(F.col("text")))).alias("shingle")).distinct()
    other = items.withColumnsRenamed({"item_id": "b"})
    return items.withColumnRenamed("item_id", "a").join(other, "shingle").where("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


#: Items without an inner word that are compared with all documents at a time.
ITEM_BLOCK = 1000


@register("SELECT d.doc_id, b.item_id, CASE WHEN starts_with(d.text, b.text) THEN 1 ELSE 2 END AS tier FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold an item's whole text: item and document meet on a word that begins the item, then are compared."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item")).where("item IS NOT NULL")
    # the longest inner word of an item lies whole, between blanks, in every text that holds the item
    inner = F.filter(F.split("item", " "), lambda w: w != "")
    middle = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    keyed = items.withColumn("key", F.array_max(F.transform(middle, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("key"))
    keys = keyed.where("key IS NOT NULL").select("key").distinct()
    met = tokens.join(keys, "key", "left_semi").join(keyed, "key").where(F.contains("text", "item"))
    both = met.select("doc_id", "item_id", "text", "item")
    # items without an inner word lie anywhere in a text: all of them are compared, in blocks of about ITEM_BLOCK
    loose = keyed.where("key IS NULL").select("item_id", "item")
    blocks = -(-loose.count() // ITEM_BLOCK)
    for block in range(blocks):
        part = loose.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block)
        both = both.unionByName(docs.join(F.broadcast(part), F.contains("text", "item")).select("doc_id", "item_id", "text", "item"))
    return both.select("doc_id", "item_id", F.when(F.startswith("text", "item"), 1).otherwise(2).alias("tier"))


@register("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'Reasoning' ELSE 'Facts' END AS role,
    '[' || CASE WHEN l.quality = 1 THEN 'Reasoning' ELSE 'Facts' END || '] ' || d.text AS embedded,
    lower(CASE WHEN l.quality = 1 THEN 'Reasoning' ELSE 'Facts' END) AS slug FROM documents d JOIN labels l USING (doc_id)""")
def label_prefix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("quality") == 1, "Reasoning").otherwise("Facts")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("role", role)
    embedded = F.concat(F.lit("["), "role", F.lit("] "), "text")
    return rows.select("doc_id", tx.canonical_role(tx.role_slug(F.col("role"))).alias("role"), embedded.alias("embedded"), tx.role_slug(F.col("role")).alias("slug"))


@register("""SELECT doc_id, substr('Case ' || source || ' 2001 Judges: A, B. ' || substr(text, 1, 100), 1, 500) AS tag,
    CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || '...' ELSE text END AS cut FROM documents""")
def context_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    judges = F.array_join(F.slice(F.array(F.lit("A"), F.lit("B")), 1, 6), ", ")
    tag = F.concat(F.lit("Case "), F.col("source"), F.lit(" 2001 Judges: "), judges, F.lit(". "), F.substring("text", 1, 100))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(tag, 1, 500).alias("tag"), tx.truncate(F.col("text"), 8000).alias("cut"))


@register("SELECT conv_id, substr(string_agg(text, ' ' ORDER BY turn) FILTER (turn < 3), 1, 500) AS summary FROM conversations GROUP BY conv_id")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three units, joined and cut."""
    first = table(spark, sf_dir, "conversations").where("turn < 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return first.select("conv_id", F.substring(F.array_join(F.transform("t", lambda x: x["text"]), " "), 1, 500).alias("summary"))


@register("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN list_sort(['[2024] UKSC ' || o_orderkey, '[1996] AC 1', '[2001] EWCA Civ 12']) WHEN 1 THEN [] ELSE ['[2010] EAT ' || o_orderkey] END AS cites,
    CASE o_orderkey % 3 WHEN 0 THEN '[2024] UKSC ' || o_orderkey WHEN 1 THEN 'Unknown Citation' ELSE '[2010] EAT ' || o_orderkey END AS main,
    CASE o_orderkey % 3 WHEN 0 THEN ['Hale', 'REID'] WHEN 1 THEN ['Atkin', 'Simon'] ELSE ['Walsh'] END AS judges, CASE o_orderkey % 3 WHEN 0 THEN 'UKSC' WHEN 2 THEN 'EAT' END AS court FROM orders""")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, judges and court of three kinds of texts made of the orders."""
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 3
    first = F.concat(F.lit("The Supreme Court in [2024] UKSC "), key, F.lit(" and [1996] AC 1 and [2001] EWCA Civ 12; [1990] 2 XY 605.\nLORD REID: I agree.\nMrs Justice Hale observed it."))
    text = F.when(kind == 0, first).when(kind == 1, "No citation here. Lord Atkin said so. Viscount Simon agreed.").otherwise(F.concat(F.lit("[2010] EAT "), key, F.lit("\nWalsh J.: The facts are these.")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.citations(text).alias("cites"), tx.main_citation(text).alias("main"), tx.judges(text).alias("judges"), tx.court_of(text)["code"].alias("court")
    )


@register("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_orderkey % 50 < 25 THEN 'facts' ELSE 'analysis' END WHEN 1 THEN 'history_lower_court' WHEN 2 THEN 'conclusion' ELSE 'analysis' END AS section,
    o_orderkey % 50 < 10 AND o_orderkey % 6 IN (3, 4) AS dissent FROM orders""")
def court_section_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section and dissent of paragraphs by their text and number."""
    key = F.col("o_orderkey")
    kinds = ("Background facts\nmore", "In the Court of Appeal it was held", "For these reasons I would allow it", "I dissent from this", "And here I dissent", "Plain text")
    text = F.element_at(F.array(*map(F.lit, kinds)), (key % 6 + 1).cast("int"))
    number = (key % 50).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.section_type(text, number, F.lit(True)).alias("section"), tx.dissents(text, number).alias("dissent"))


@register(rf"""WITH p AS (SELECT conv_id, turn, trim(text, {_WS}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS blocks FROM conversations WHERE NOT regexp_matches(text, '\n\s*\d+\.\s') AND NOT regexp_matches(text, '\n\s*\n') AND trim(text, {_WS}) <> '')
    SELECT conv_id, CAST(n AS INTEGER) AS number, body AS part, CAST(blocks AS BIGINT) AS blocks FROM p""")
def numbered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered paragraphs and blank-line blocks of texts made of the turns of conversations."""
    rows = table(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"\n\s*\d+\.\s") & ~F.col("text").rlike(r"\n\s*\n") & (tx.strip(F.col("text")) != ""))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    numbered = F.array_join(F.transform("t", lambda x, at: F.concat(F.lit("\n "), (at + 1).cast("string"), F.lit(". "), x["text"])), "\n")
    blocks = F.size(tx.blank_line_paragraphs(F.array_join(F.transform("t", lambda x: x["text"]), "\n \n"))).cast("long")
    return listed.select("conv_id", blocks.alias("blocks"), F.inline(tx.numbered_paragraphs(F.concat(F.lit("Preamble"), numbered)))).select("conv_id", "number", F.col("text").alias("part"), "blocks")


_NAMED = "CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN 'INTRODUCTION' WHEN 1 THEN 'the facts' WHEN 2 THEN 'Judgment or reasoning' WHEN 3 THEN 'Doctrine and Policy' WHEN 4 THEN 'authority' ELSE '' END"
_GIVEN = f"'1. ' || substr(text, 1, 30) || chr(10) || '2) ' || {_NAMED} || ' ' || substr(text, 31, 20)"


@register(rf"""SELECT conv_id, turn, CASE WHEN contains(lower(a), 'introduction') THEN 'Introduction' WHEN contains(lower(a), 'facts') THEN 'Facts' WHEN contains(lower(a), 'authority') THEN 'Authority' WHEN contains(lower(a), 'doctrine and policy') THEN 'Doctrine and Policy'
    WHEN contains(lower(a), 'reasoning') THEN 'Reasoning' WHEN contains(lower(a), 'judgment') THEN 'Judgment' ELSE 'Reasoning' END AS role, regexp_extract(a, '\n2[.)]\s*([^\n]+)', 1) AS second,
    substr(a, 4, 1) = upper(substr(a, 4, 1)) AS third FROM (SELECT conv_id, turn, {_GIVEN} AS a FROM conversations)""")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifiers' answers about every turn: the first role that they name, else the default; their second line and a letter."""
    text = F.expr(_GIVEN.replace("chr(10)", "char(10)"))
    initial = F.substring(text, 4, 1)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce(tx.canonical_role(text), F.lit("Reasoning")).alias("role"), F.regexp_extract(text, r"\n2[.)]\s*([^\n]+)", 1).alias("second"), (initial == F.upper(initial)).alias("third"),
    )


_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''))"


def _scores_sql(short: str, table_sql: str = "documents") -> str:
    ratio = f"length({short}) / length(text)"
    return f"""SELECT doc_id, round(CASE WHEN len({_WORDS.format('text')}) = 0 THEN 0.0 ELSE len(list_intersect({_WORDS.format('text')}, {_WORDS.format(short)})) / len({_WORDS.format('text')}) END, 6) AS meaning,
        round(CASE WHEN {ratio} >= 0.8 AND {ratio} <= 0.9 THEN 1.0 WHEN {ratio} < 0.8 THEN {ratio} / 0.8 ELSE greatest(0.0, 1.0 - ({ratio} - 0.9) * 10) END, 6) AS paraphrase,
        round(CASE WHEN 1 - {ratio} >= 0.1 AND 1 - {ratio} <= 0.2 THEN 1.0 WHEN 1 - {ratio} < 0.1 THEN (1 - {ratio}) / 0.1 ELSE greatest(0.0, 1.0 - (1 - {ratio} - 0.2) * 5) END, 6) AS length FROM {table_sql}"""


@register(_scores_sql("substr(text, 1, CAST(length(text) * 83 // 100 AS INTEGER))"))
def shorten_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    short = F.substring(text, F.lit(1), F.expr("int(length(text) * 83 div 100)"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(tx.meaning_score(text, short), 6).alias("meaning"), F.round(tx.paraphrase_score(text, short), 6).alias("paraphrase"),
        F.round(tx.length_score(text, short), 6).alias("length"),
    )


@register("WITH c AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS candidate, round(meaning + paraphrase + length, 6) AS score FROM ({_scores_sql(f'substr(text, 1, CAST(length(text) * {p} // 100 AS INTEGER))')})" for i, p in enumerate((95, 85, 60))
) + ") SELECT doc_id, arg_max(candidate, score * 10 - candidate) AS candidate, max(score) AS score, max(score) >= 1.5 AS again FROM c GROUP BY doc_id")
def shorten_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round: the best of three candidates by the sum of scores, the first of equals; below 1.5 it ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = docs.select("*", tx.distinct_words(F.col("text")).alias("words"), F.posexplode(F.array(F.lit(95), F.lit(85), F.lit(60))).alias("candidate", "p"))
    text, short = F.col("text"), F.substring(F.col("text"), F.lit(1), F.expr("int(length(text) * p div 100)"))
    six = [F.round(score, 6) for score in (tx.meaning_of(F.col("words"), short), tx.paraphrase_score(text, short), tx.length_score(text, short))]
    scored = cut.withColumn("score", F.round(six[0] + six[1] + six[2], 6))
    best = scored.groupBy("doc_id").agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("candidate"), F.max("score").alias("score"))
    return best.withColumn("again", F.col("score") >= 1.5)


ORACLES["shorten_best"] = ORACLES["shorten_best"].replace("arg_max(candidate, score * 10 - candidate)", "arg_max(candidate, {'s': score, 'c': -candidate})")


@register("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS BIGINT) AS tokens, regexp_extract(text, '[A-Za-z0-9_]+') AS first FROM documents")
def highlight_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("tokens"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("first"))


_WORDS_OF = """SELECT {0}, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+'), 1) AS nth,
        unnest(regexp_extract_all(text, '([^A-Za-z0-9_]*)[A-Za-z0-9_]+', 1)) AS gap FROM {1}"""


@register(f"""WITH w AS ({_WORDS_OF.format('doc_id', 'documents')}), b AS ({_WORDS_OF.format('item_id', 'benchmark')}),
    marks AS (SELECT DISTINCT word, next FROM (SELECT word, lead(word) OVER (PARTITION BY item_id ORDER BY nth) AS next FROM b) WHERE next IS NOT NULL),
    o AS (SELECT doc_id, nth, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY nth) AS BIGINT) AS stop FROM w),
    s AS (SELECT o.doc_id, o.stop - length(o.word) AS a, n.stop AS b FROM o JOIN o n ON n.doc_id = o.doc_id AND n.nth = o.nth + 1 JOIN marks m ON m.word = o.word AND m.next = n.word),
    r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    g AS (SELECT *, count(*) FILTER (reach IS NULL OR a > reach) OVER (PARTITION BY doc_id ORDER BY a, b) AS island FROM r),
    i AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, island UNION ALL SELECT doc_id, length(text), length(text) FROM documents WHERE length(text) > 0),
    p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS before FROM i),
    c AS (SELECT doc_id, a, b, true AS lit FROM p WHERE b > a UNION ALL SELECT doc_id, before, a, false FROM p WHERE a > before)
    SELECT doc_id, CAST(a AS INTEGER) AS begin, CAST(b AS INTEGER) AS end, lit, md5(substr(text, a + 1, b - a)) AS segment FROM c JOIN documents USING (doc_id)""")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at the benchmark's pairs of words, which overlap and touch; every text is covered once."""
    from casemill.operators.cases import highlight_segments as segments
    from casemill.operators.cases import word_offsets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def paired(words: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy("nth")
        return words.withColumns({"next": F.lead("word").over(order), "end": F.lead("stop").over(order)}).where("next IS NOT NULL")

    marks = paired(word_offsets(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text"), "item_id").select("word", "next").distinct()
    spans = paired(word_offsets(docs, "doc_id", "text"), "doc_id").join(marks, ["word", "next"], "left_semi").select("doc_id", "start", F.col("end").alias("stop"))
    return segments(docs, spans, "doc_id", "text").withColumn("segment", F.md5("segment"))


_JUNK = [(1, "[ Home ] [ Databases ] something long enough"), (2, "Times New Roman; Default Paragraph Font; normal"), (3, "THE SUPREME COURT"), (4, "A real paragraph of the judgment, long enough to be kept as context here."), (5, "short"), (6, "As was held in Donoghue v."), (7, "the passage cited above at p.")]


@register(f"""SELECT id, id IN (1, 3, 5) AS navigation, id IN (2) AS formatting, id IN (4) AS substantive, id <> 4 AS bad_context, id IN (6, 7) AS truncated FROM {values_sql(_JUNK, 'id, text')}
    UNION ALL SELECT 1000 + doc_id, length(text) < 20, false, length(trim(text, {_WS})) >= 50,
        length(trim(text, {_WS})) < 50 OR (upper(text) = text AND length(trim(text, {_WS})) < 80), false FROM documents""")
def boilerplate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    text = F.col("text")
    return literal_rows(spark, "id long, text string", _JUNK).unionByName(docs).select(
        "id", tx.is_navigation(text).alias("navigation"), tx.is_formatting(text).alias("formatting"), tx.is_substantive(text).alias("substantive"),
        tx.is_bad_context(text).alias("bad_context"), tx.is_truncated(text).alias("truncated"),
    )


@register(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


#: page_id, position, text of every opened paragraph.
PARAGRAPHS_SQL = rf"""SELECT page_id, position, trim(regexp_replace(regexp_replace(regexp_replace(p, '{ENDS}', ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (
    SELECT page_id, unnest(string_split_regex(html, '{OPENS}')[2:]) AS p, generate_subscripts(string_split_regex(html, '{OPENS}')[2:], 1) - 1 AS position FROM pages)"""


@register(f"""SELECT page_id, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars, max(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM ({PARAGRAPHS_SQL}) WHERE length(text) >= 10 GROUP BY page_id""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every page, with tags inside it or without an end tag too."""
    rows = extracted_paragraphs(table(spark, sf_dir, "pages"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.max(tx.escape_markup(F.col("text"))).alias("escaped"))


@register()
def html_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, list items and table rows of every page, in that order."""
    from casemill.sources.html import structured_text

    return structured_text(table(spark, sf_dir, "pages"))


@register()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.operators.chunking import pack_chunks

    return pack_chunks(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("paragraphs")))


@register()
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.operators.chunking import even_chunks

    return even_chunks(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("paragraphs")))


@register(f"SELECT conv_id, turn, trim(translate(text, chr(9) || chr(10) || chr(13), '   '), {_WS}) AS cell, substr(text, greatest(length(text) - 99, 1)) AS tail, CASE WHEN role = 'user' THEN role || ': ' || text ELSE text END AS query, trim(text, {_WS}) = '' AS rejected FROM conversations")
def text_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.sanitize_cell(text).alias("cell"), F.substring(text, F.greatest(F.length(text) - 99, F.lit(1)), F.length(text)).alias("tail"),
        F.when(F.col("role") == "user", F.concat("role", F.lit(": "), "text")).otherwise(text).alias("query"), (tx.strip(text) == "").alias("rejected"),
    )


@register(f"""WITH p AS (SELECT d.doc_id, b.item_id, d.text AS a, b.text AS b FROM documents d JOIN benchmark b ON contains(d.text, b.text))
    SELECT doc_id, item_id, round(len(list_intersect({_WORDS.format('b')}, {_WORDS.format('a')})) / len({_WORDS.format('b')}), 6) AS overlap FROM p""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = benchmark_containment(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    return pairs.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", F.round(tx.meaning_score(F.col("b"), F.col("a")), 6).alias("overlap"))
