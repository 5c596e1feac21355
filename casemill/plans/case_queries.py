"""Cases: speakers, answers of classifiers, repair, suggestion reports and what is written of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import judgments as jd
from casemill.functions import text as tx
from casemill.models import ROLE_WORDS, VARIANTS, HashingEmbedder
from casemill.operators import cases, corpus, relational, reports
from casemill.plans.registry import Registry
from casemill.plans.tables import table
from casemill.plans.text_queries import PARAGRAPHS_SQL, _split_sql
from casemill.scratch import fresh
from casemill.sources.html import extracted_paragraphs

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_WS = "' ' || chr(10) || chr(9) || chr(13)"


# ---- suggestion reports --------------------------------------------------------------------------------------------


@register(f"""WITH p AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(lag(text) OVER w, '') AS previous, coalesce(lead(text) OVER w, '') AS following
        FROM (SELECT conv_id, turn, trim(text, {_WS}) AS text FROM conversations) WHERE length(text) > 50 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    f AS (SELECT conv_id, text, arg_min(previous, p) AS previous, arg_min(following, p) AS following FROM p GROUP BY ALL)
    SELECT p.conv_id, CASE WHEN n < 3 THEN CASE WHEN p = 0 THEN 'beginning' ELSE 'end' END WHEN p = 0 THEN 'beginning' WHEN p = n // 2 THEN 'middle' ELSE 'end' END AS pick, p.text, f.previous, f.following
    FROM p JOIN f USING (conv_id, text) WHERE n < 3 OR p = 0 OR p = n // 2 OR p = n - 1""")
def test_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.test_neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their case's short name, year and judges: one row of metadata for each source but those that end in 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    meta = docs.where("source NOT LIKE '%3'").groupBy("source").agg(
        F.concat(F.lit("In re "), F.first("source")).alias("short_name"), (F.min("doc_id") % 90 + 1900).cast("string").alias("year"),
        F.array_sort(F.collect_set(F.when(F.col("lang") != "en", F.upper("lang")))).alias("judges"),
    )
    return docs.join(meta, "source", "left")


_META = """(SELECT d.*, m.short_name, m.year, m.judges FROM documents d LEFT JOIN (SELECT source, 'In re ' || source AS short_name, CAST(min(doc_id) % 90 + 1900 AS VARCHAR) AS year,
    list_sort(list_distinct(list(upper(lang)) FILTER (lang <> 'en'))) AS judges FROM documents WHERE source NOT LIKE '%3' GROUP BY source) m ON m.source = d.source)"""
_TAG = f"""coalesce(short_name, source) || ' ' || coalesce(year, '') || ' Judges: ' || CASE WHEN len(judges) > 0 THEN array_to_string(judges[1:6], ', ') ELSE 'Various' END || '. ' || replace(substr(trim(text, {_WS}), 1, 100), chr(10), ' ')"""


@register(f"SELECT doc_id, {_TAG} AS tag FROM {_META}")
def case_context_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_metadata(spark, sf_dir)
    return rows.select("doc_id", jd.context_tag(F.coalesce("short_name", "source"), F.col("year"), F.col("judges"), F.col("text")).alias("tag"))


@register(f"""WITH s AS (SELECT conv_id, arg_min(text, turn) AS summary FROM conversations GROUP BY conv_id), r AS (
    SELECT d.doc_id, '[' || CASE WHEN l.quality = 1 THEN 'Reasoning' ELSE 'Facts' END || '] ' AS role, trim(d.text, {_WS}) AS t, {_TAG} AS tag, s.summary
    FROM {_META} d JOIN labels l USING (doc_id) LEFT JOIN s ON s.conv_id = d.doc_id)
    SELECT doc_id, unnest(['v1', 'v2', 'v3', 'v4']) AS variant, unnest([role || t, role || tag || ' ' || t, role || CASE WHEN summary IS NULL THEN '' ELSE summary || ' ' END || t, role || tag || ' ' || t]) AS query FROM r""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the four retrieval variants embed: role, context tag or summary (the first row of a case), and the paragraph."""
    first = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("summary"))
    rows = _with_metadata(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").join(first, "doc_id", "left")
    role, text = F.when(F.col("quality") == 1, "Reasoning").otherwise("Facts"), tx.strip(F.col("text"))
    tag = jd.context_tag(F.coalesce("short_name", "source"), F.col("year"), F.col("judges"), F.col("text"))
    forms = F.array(*[F.struct(F.lit(name).alias("variant"), F.when(F.lit(name == "v3") & F.col("summary").isNull(), VARIANTS["v1"](role, text, tag, text)).otherwise(form(role, text, tag, F.col("summary"))).alias("query")) for name, form in VARIANTS.items()])
    return rows.select("doc_id", F.inline(forms))


_CITED = r"\s*\(([^)]+)\)\s*$"
_SUGGESTED = "text || ' (' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'src ' || source END || ')' || CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE '' END"


@register(f"""SELECT doc_id, trim(regexp_replace({_SUGGESTED}, '{_CITED}', ''), {_WS}) AS text, trim(regexp_extract({_SUGGESTED}, '{_CITED}', 1), {_WS}) AS citation,
    CASE WHEN doc_id % 4 = 0 THEN source ELSE rtrim(substr(text, 1, 20)) || ' ' || source END AS draft FROM documents""")
def suggestion_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestion cells back to text and citation, and a draft that takes one up."""
    docs = table(spark, sf_dir, "documents")
    cite = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("src "), F.col("source")))
    cell = F.concat(jd.suggestion(F.col("text"), cite), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(""))
    back = jd.suggested(cell)
    draft = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.substring("text", 1, 20))
    return docs.select("doc_id", tx.strip(back["text"]).alias("text"), back["citation"].alias("citation"), jd.inserted(draft, F.col("source")).alias("draft"))


@register("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each document with the next one, to four places."""
    from casemill.functions import vector as vx

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(vx.cosine(F.col("vec"), F.col("other")), 4).alias("similarity"))


@register("""WITH g AS (SELECT q, unnest(['s1', 's2', 's3']) AS place, unnest([a, b, c]) AS value, unnest([a > 50, b > 50, c > 50]) AS mark FROM (SELECT p_partkey AS q, p_size AS a, p_partkey % 97 AS b, p_size * 2 AS c FROM part))
    SELECT q, place, CAST(value AS BIGINT) AS value, CASE WHEN mark THEN 'Verbatim' END AS mark FROM g""")
def verbatim_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of scores with the grid of marks, cell by cell."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), F.col("p_size").cast("long").alias("s1"), (F.col("p_partkey") % 97).cast("long").alias("s2"), (F.col("p_size") * 2).cast("long").alias("s3"))
    marks = parts.select("q", *[F.when(F.col(c) > 50, "Verbatim").otherwise("").alias(c) for c in ("s1", "s2", "s3")])
    return cases.aligned_cells(parts, marks, "q", ["s1", "s2", "s3"]).withColumn("mark", F.nullif("mark", F.lit("")))


# ---- names, searches, repair ---------------------------------------------------------------------------------------


@register("""SELECT p_partkey, substr(trim(regexp_replace(p_name, '[\\s_,\\-]+', ' ', 'g')) || ' Acme Co Ltd', 1, 80) AS query,
    CASE WHEN p_partkey % 2 = 0 THEN 'ukhl/' || (1900 + p_partkey % 100) || '/' || CASE WHEN p_partkey % 4 = 0 THEN '1' ELSE CAST(p_size AS VARCHAR) END END AS uri, p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS skipped FROM part""")
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search words of a case name, the address in a file name, and names that are left out."""
    key = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" v  Acme_Co, Ltd [1999] AC 1"))
    number = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("_"), F.col("p_size").cast("string")))
    file = F.when(key % 2 == 0, F.concat(F.lit("A_v_B__"), (key % 100 + 1900).cast("string"), F.lit("__UKHL"), number, F.lit("__x.pdf"))).otherwise("A_v_B.pdf")
    stem = F.when(key % 7 == 0, "Cromane_Test_1").when(key % 11 == 0, "McLoughlin v O'Brian").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(key, jd.search_query(name).alias("query"), jd.document_uri(file).alias("uri"), jd.is_skipped(stem).alias("skipped"))


@register("""WITH w AS (SELECT p_partkey AS q, unnest(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_partkey % 20 = 0),
    h AS (SELECT q, p_partkey AS id, count(*) AS n FROM w JOIN part ON length(w) > 1 AND contains(lower(p_name), w) WHERE p_partkey % 20 <> 0 GROUP BY ALL)
    SELECT q, arg_max(id, {'n': n, 'i': -id}) AS id, max(n) AS n FROM h GROUP BY q""")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title that holds most words of each query."""
    parts = table(spark, sf_dir, "part")
    wanted = parts.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("q"), F.split("p_name", " ").alias("words"))
    titles = parts.where("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return cases.best_titles(wanted, titles)


@register("""SELECT max(CAST(y AS INTEGER)) AS first_year, min(CAST(y AS INTEGER)) AS last_year, list(k ORDER BY CAST(y AS INTEGER) DESC, k)[1:5] AS first FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE year(o_orderdate) END AS y FROM orders)""")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the year in square brackets, latest first, files without one last: the range and the first five."""
    key = F.col("o_orderkey")
    name = F.when(key % 10 == 0, "no year.xml").otherwise(F.concat(F.lit("["), F.year("o_orderdate").cast("string"), F.lit("] UKSC "), key.cast("string"), F.lit(".xml")))
    files = table(spark, sf_dir, "orders").select(key.alias("k"), F.coalesce(F.nullif(tx.bracketed_year(name), F.lit("")).cast("int"), F.lit(0)).alias("y"))
    first = files.orderBy(F.desc("y"), "k").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), "k"))).alias("f"))
    return files.agg(F.max("y").alias("first_year"), F.min("y").alias("last_year")).crossJoin(first).select("first_year", "last_year", F.col("f.k").alias("first"))  # single rows


_PIECES = f"""SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x, {_WS})), lambda x: length(x) >= 40) AS s FROM documents"""


@register(f"""WITH d AS ({_PIECES}), c AS (SELECT doc_id, 1 AS kind, substr(s[1], 1, 30) AS cell FROM d WHERE len(s) > 0 UNION ALL SELECT doc_id, 2, trim(substr(s[2], 6, 30), {_WS}) FROM d WHERE len(s) > 1
        UNION ALL SELECT doc_id, 3, replace(substr(s[3], 1, 35), ' ', '  ') FROM d WHERE len(s) > 2),
    s AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM d),
    m AS (SELECT c.doc_id, c.cell, sentence, pos, CASE WHEN starts_with(sentence, trim(cell, {_WS})) THEN 1 WHEN contains(sentence, trim(cell, {_WS})) THEN 2
        WHEN starts_with(lower(trim(regexp_replace(sentence, '\\s+', ' ', 'g'))), substr(lower(trim(regexp_replace(cell, '\\s+', ' ', 'g'))), 1, 80)) THEN 3 END AS tier FROM (SELECT DISTINCT doc_id, cell FROM c) c JOIN s USING (doc_id))
    SELECT doc_id, cell, arg_min(sentence, tier * 100000 + pos) AS repaired, min(tier) AS tier FROM m WHERE tier IS NOT NULL GROUP BY ALL""")
def sentence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-off sentences to the whole ones: one that begins with them, else holds them, else begins alike; documents meet by name."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = F.filter(F.transform(F.split("text", r"\. "), tx.strip), lambda x: F.length(x) >= 40)
    cut = texts.select("doc_id", parts.alias("s"))
    cells = F.filter(F.array(F.substring(F.get("s", F.lit(0)), 1, 30), tx.strip(F.substring(F.get("s", F.lit(1)), 6, 30)), F.replace(F.substring(F.get("s", F.lit(2)), 1, 35), F.lit(" "), F.lit("  "))), lambda c: c.isNotNull())
    named = cut.select(F.concat(F.lit("The Reported Case Number "), F.col("doc_id").cast("string"), F.lit(" (UK)")).alias("document"), "doc_id", "s", cells.alias("cells"))
    name = F.lower(F.concat(F.col("document"), F.lit("  [1999] AC 1"))).alias("name")
    wanted = named.select(F.explode("cells").alias("cell"), name)
    sentences = named.select("document", F.posexplode("s").alias("position", "sentence"))
    documents = named.select("document", F.col("doc_id").alias("rank"))
    found = wanted.join(cases.matched_documents(named.select(name), documents), "name").select("cell", "document")
    repaired = cases.repaired_texts(found, sentences)
    return repaired.join(named.select("document", "doc_id"), "document").select("doc_id", "cell", "repaired", "tier")


_REPORT = f"""d AS ({_PIECES}), p AS (SELECT doc_id, s, list_transform(s, lambda x: substr(x, 1, 30) || ' Smith v. Jones ' || substr(x, 31)) AS w FROM d),
    u AS (SELECT doc_id, unnest(w) AS sentence, generate_subscripts(w, 1) AS pos FROM p),
    r AS (SELECT doc_id, substr(s[1], 1, 30) || ' Smith v.' AS top, substr(s[2], 6, 25) || ' Smith v.' AS second, w[3] AS third FROM p),
    c AS (SELECT doc_id, 1 AS slot, trim(top, {_WS}) AS cell FROM r WHERE top IS NOT NULL UNION ALL SELECT doc_id, 2, trim(second, {_WS}) FROM r WHERE second IS NOT NULL),
    t AS (SELECT c.doc_id, slot, sentence, pos, CASE WHEN starts_with(sentence, cell) OR contains(sentence, cell) AND starts_with(sentence, substr(cell, 1, 50)) THEN 1 WHEN contains(sentence, cell) THEN 2 END AS tier FROM c JOIN u USING (doc_id)),
    m AS (SELECT doc_id, slot, arg_min(sentence, tier * 100000 + pos) AS whole FROM t WHERE tier IS NOT NULL GROUP BY ALL)"""


@register(f"""WITH {_REPORT} SELECT r.doc_id, coalesce(a.whole || ' (CASE  ' || r.doc_id || ')', top) AS top_suggestion, coalesce(b.whole, second) AS second, third, CAST((a.whole IS NOT NULL)::INT + (b.whole IS NOT NULL)::INT AS INTEGER) AS repaired
    FROM r LEFT JOIN m a ON a.doc_id = r.doc_id AND a.slot = 1 LEFT JOIN m b ON b.doc_id = r.doc_id AND b.slot = 2""")
def report_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report whose cells were cut off within a case's name, written back whole: the first from its beginning, the second from within."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = F.filter(F.transform(F.split("text", r"\. "), tx.strip), lambda x: F.length(x) >= 40)
    cited = F.transform("s", lambda x: F.concat(F.substring(x, 1, 30), F.lit(" Smith v. Jones "), F.substr(x, F.lit(31))))
    named = texts.select("doc_id", parts.alias("s")).withColumn("w", cited)
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    citation = F.concat(F.lit("CASE  "), F.col("doc_id").cast("string"))
    report = named.select(
        "doc_id", F.concat(F.substring(first, 1, 30), F.lit(" Smith v.")).alias(reports.TOP), citation.alias(reports.TOP_CITATION),
        F.concat(F.substring(second, 6, 25), F.lit(" Smith v.")).alias("Suggestion 2 Text"), citation.alias("Suggestion 2 Citation"),
        F.get("w", F.lit(2)).alias("Suggestion 3 Text"), citation.alias("Suggestion 3 Citation"),
    )
    sentences = named.select(F.concat(F.lit("Case "), F.col("doc_id").cast("string")).alias("document"), F.col("doc_id").alias("rank"), F.posexplode("w").alias("position", "sentence"))
    whole = reports.repaired_report(report, sentences, ["doc_id"])
    return whole.select("doc_id", F.col(reports.TOP).alias("top_suggestion"), F.col("Suggestion 2 Text").alias("second"), F.col("Suggestion 3 Text").alias("third"), F.col("__repaired").alias("repaired"))


@register("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN count(*) >= 3 ELSE count(*) FILTER (text = upper(text)) >= 3 END AS resume FROM conversations WHERE turn < 5 GROUP BY conv_id""")
def resume_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least three of the first five stored paragraphs are the current ones; those of odd cases have changed."""
    rows = table(spark, sf_dir, "conversations").where("turn < 5")
    stored = rows.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.upper("text")).alias("stored"))
    return stored.join(rows.select("conv_id", "turn", "text"), ["conv_id", "turn"]).groupBy("conv_id").agg((F.count_if(F.col("stored") == F.col("text")) >= 3).alias("resume"))


@register("""SELECT c.conv_id, c.turn, coalesce(s.summary, '') AS summary FROM conversations c LEFT JOIN (SELECT source, arg_min(text, doc_id) AS summary FROM documents GROUP BY source) s ON s.source = 'src' || (c.conv_id % 25)""")
def summary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a paragraph's case: its first row, empty where there is none."""
    summaries = table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("summary"))
    rows = table(spark, sf_dir, "conversations").withColumn("source", F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")))
    return rows.join(summaries, "source", "left").select("conv_id", "turn", F.coalesce("summary", F.lit("")).alias("summary"))


_SENTENCE_COUNT = f"len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: length(trim(s, {_WS})) >= 10))"


@register(f"""WITH s AS (SELECT conv_id, turn, text, {_SENTENCE_COUNT} AS n FROM conversations), u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM s),
    t AS (SELECT conv_id, CAST(unnest(generate_series(0, CAST(max(upto) + 1 AS BIGINT))) AS BIGINT) AS slot FROM u GROUP BY conv_id)
    SELECT t.conv_id, t.slot, coalesce(substr(u.text, 1, 100), '') AS preview FROM t LEFT JOIN u ON u.conv_id = t.conv_id AND t.slot >= u.upto - u.n AND t.slot < u.upto""")
def sentence_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with the beginning of its paragraph, by running counts of sentences; beyond the last it is empty."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.size(tx.sentences(F.col("text"), protect=False)).cast("long").alias("n"))
    upto = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn")))
    slots = upto.where("n > 0").select("conv_id", F.substring("text", 1, 100).alias("preview"), F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("slot"))
    wanted = upto.groupBy("conv_id").agg(F.max("upto").alias("total")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") + 1)).alias("slot"))
    return wanted.join(slots, ["conv_id", "slot"], "left").select("conv_id", "slot", F.coalesce("preview", F.lit("")).alias("preview"))


# ---- speakers, opinions, answers -----------------------------------------------------------------------------------

_DENSE = "(SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS turn FROM conversations)"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their turns numbered without gaps from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "text", (F.row_number().over(order) - 1).alias("turn"))


_SPEAKERS = ("LORD REID", "LADY HALE and LORD KERR", "LADY BLACK-DISSENTING", "LORD ATKIN")
_HEADINGS = "['" + "', '".join(_SPEAKERS) + "']"


@register(f"""SELECT conv_id, CAST(turn AS INTEGER) + 1 AS place, {_HEADINGS}[turn % 4 + 1] AS author, trim(text, {_WS}) AS text, CASE WHEN turn % 4 = 2 THEN 'dissenting' WHEN turn = 0 THEN 'majority' ELSE 'concurring' END AS opinion
    FROM {_DENSE} WHERE length(trim(text, {_WS})) > 50""")
def judge_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments, made of the turns under judges' names, split at their headings."""
    names = F.array(*map(F.lit, _SPEAKERS))
    rows = _dense(spark, sf_dir).withColumn("part", F.concat(F.lit("\n"), F.element_at(names, (F.col("turn") % 4 + 1).cast("int")), F.lit(":\n"), "text"))
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "").alias("text"))
    return whole.select("conv_id", F.inline(jd.speeches(F.concat(F.lit("Heard in open court."), "text"))))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'UKSC' WHEN 1 THEN event_type WHEN 2 THEN 'EAT' ELSE 'UKSC' END AS court, CASE event_id % 4 WHEN 1 THEN 'Majority  view' ELSE CASE event_id % 4 WHEN 0 THEN 'Concurring' ELSE 'Majority' END END AS opinion FROM events""")
def court_opinion_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    cell = F.when(kind == 0, "UKSC Concurring").when(kind == 1, F.concat(F.lit(" "), "event_type", F.lit("\tMajority  view "))).when(kind == 2, "EAT").otherwise(" ")
    return table(spark, sf_dir, "events").select("event_id", F.inline(F.array(jd.court_and_opinion(cell))))


@register("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'dissenting' WHEN doc_id % 3 = 1 THEN 'concurring' ELSE 'majority' END AS opinion, doc_id % 2 = 0 AS supreme FROM documents""")
def opinion_of_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opinion of a judgment by its end; what stands before the last 1500 characters does not count."""
    third = F.col("doc_id") % 3
    end = F.when(third == 0, "\nI respectfully disagree and would allow it.").when(third == 1, "\nI agree, and add a word.").otherwise("\nAppeal dismissed.")
    text = F.concat(F.lit("I dissent and I agree, in the "), F.when(F.col("doc_id") % 2 == 0, "[2001] UKSC 5").otherwise("tribunal"), F.repeat(F.lit(" filler"), 250), F.translate("text", "ig", "11"), end)
    court = jd.CourtConfig().court_of(text)
    return table(spark, sf_dir, "documents").select("doc_id", jd.opinion_of_tail(text).alias("opinion"), (F.coalesce(court["code"], F.lit("")) == "UKSC").alias("supreme"))


_ROLE_OF = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'Facts' WHEN 1 THEN 'Authority' ELSE 'Doctrine and Policy' END"


@register(f"SELECT conv_id, CAST(turn AS INTEGER) AS item, CASE WHEN turn > 3 THEN 'Reasoning' ELSE {_ROLE_OF} END AS role, turn <= 3 AND turn % 2 = 0 AS vote, CASE WHEN turn > 3 THEN text ELSE trim(replace(text, '[', '<'), {_WS}) END AS corrected FROM {_DENSE}")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's, a voter's and a corrector's answers for a batch, back to its items; answers that break off leave the rest to the default."""
    rows = _dense(spark, sf_dir).withColumns({"role": F.expr(_ROLE_OF), "given": F.col("turn") <= 3, "number": (F.col("turn") + 1).cast("string")})
    rows = rows.withColumns({
        "line": F.when(F.col("given"), F.concat("number", F.when(F.col("turn") % 2 == 0, ". ").otherwise(") the "), F.lower("role"), F.lit(" part"))).otherwise("nothing"),
        "letter": F.when(F.col("given") & (F.col("turn") % 2 == 0), "y").otherwise("N "),
        "block": F.when(F.col("given"), F.concat(F.lit("["), "number", F.lit("]\n"), F.replace("text", F.lit("["), F.lit("<")), F.lit("\n"))).otherwise(""),
    })
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "line", "letter", "block"))).alias("b"))
    n = F.size("b")
    roles = jd.numbered_answers(F.array_join(F.col("b.line"), "\n"), n)
    voted = jd.votes(F.array_join(F.col("b.letter"), ""), n)
    fixed = jd.corrected_blocks(F.array_join(F.col("b.block"), ""), F.col("b.text"))
    return whole.select("conv_id", F.posexplode(F.arrays_zip(roles.alias("role"), voted.alias("vote"), fixed.alias("corrected"))).alias("item", "x")).select("conv_id", "item", "x.*")


@register(f"""WITH c AS (SELECT doc_id, unnest([text, 'THE SUPREME COURT', substr(text, 1, 60)]) AS t, unnest([1, 2, 3]) AS pos FROM documents),
    g AS (SELECT *, NOT (length(trim(t, {_WS})) < 50 OR t = 'THE SUPREME COURT' OR (upper(trim(t, {_WS})) = trim(t, {_WS}) AND length(trim(t, {_WS})) < 80)) AS good FROM c),
    n AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM g)
    SELECT doc_id, list(good AND (doc_id % 2 = 1 OR k = 1) ORDER BY pos) AS valid FROM n GROUP BY doc_id""")
def content_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content by the heuristic and then by an answer's letters for those that pass it; odd documents have no answer."""
    texts = F.array(F.col("text"), F.lit("THE SUPREME COURT"), F.substring("text", 1, 60))
    answer = F.when(F.col("doc_id") % 2 == 0, "Y N N")
    return table(spark, sf_dir, "documents").select("doc_id", jd.valid_content(texts, answer).alias("valid"))


# ---- pages, files, responses ---------------------------------------------------------------------------------------


@register(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+'), 1) AS nth,
        unnest(regexp_extract_all(text, '([^A-Za-z0-9_]*)[A-Za-z0-9_]+', 1)) AS gap FROM conversations)
    SELECT conv_id, turn, CAST(nth - 1 AS INTEGER) AS nth, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY conv_id, turn ORDER BY nth) - length(word) AS BIGINT) AS start, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY conv_id, turn ORDER BY nth) AS BIGINT) AS stop FROM w""")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.word_offsets(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@register(f"SELECT page_id, coalesce(list(text ORDER BY position) FILTER (text <> ''), []) AS sentences FROM (SELECT * FROM ({PARAGRAPHS_SQL}) UNION ALL SELECT page_id, -1, '' FROM pages) GROUP BY page_id")
def page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a page that has one to a paragraph, as a list; a page without paragraphs has none."""
    pages = table(spark, sf_dir, "pages")
    rows = extracted_paragraphs(pages, least=1).unionByName(pages.select("page_id", F.lit(-1).alias("position"), F.lit(None).cast("string").alias("text")))
    listed = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text"))))
    return rows.groupBy("page_id").agg(listed.alias("t")).select("page_id", F.transform("t", lambda x: x["text"]).alias("sentences"))


@register(f"""SELECT conv_id, count(*) AS given, count(*) FILTER (turn % 3 <> 2) AS kept, list_sort(list_distinct(list({_ROLE_OF}) FILTER (turn % 3 <> 2))) AS roles FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY conv_id""")
def classified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified pages read back: paragraphs without a class take the default or go, as the reader is told."""
    from casemill.sources.html import classified_paragraphs

    rows = table(spark, sf_dir, "conversations").where(tx.collapse(F.col("text")) != "").withColumn("slug", tx.role_slug(F.expr(_ROLE_OF)))
    given = F.when(F.col("turn") % 3 == 2, "<p>").otherwise(F.concat(F.lit('<p class="para-'), "slug", F.lit('">')))
    line = F.concat(given, tx.escape_markup(F.col("text")), F.lit("</p>"))
    pages = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("html"))
    lax = classified_paragraphs(pages, "conv_id", default="Reasoning").groupBy("conv_id").agg(F.count(F.lit(1)).alias("given"))
    strict = classified_paragraphs(pages, "conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"), F.array_sort(F.collect_set("role")).alias("roles"))
    return lax.join(strict, "conv_id", "left").select("conv_id", "given", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


ORACLES["classified_pages"] = ORACLES["classified_pages"].replace("FILTER (turn % 3 <> 2))) AS roles", "FILTER (turn % 3 <> 2))) AS roles").replace(
    "list_sort(list_distinct(list(", "coalesce(list_sort(list_distinct(list("
).replace("FILTER (turn % 3 <> 2))) AS roles", "FILTER (turn % 3 <> 2))), []) AS roles")


def _escaped_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register(f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>Case ' || doc_id || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
    || string_agg('<p id="p' || i || '" data-content-type="">[' || i || '] ' || {_escaped_sql('p')} || '</p>', chr(10) ORDER BY i) || chr(10) || '</body>' || chr(10) || '</html>' AS html FROM p WHERE i <= 600 GROUP BY doc_id""")
def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of numbered paragraphs; such a page holds at most 600."""
    title = F.concat(F.lit("Case "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", jd.numbered_page(title, F.split("text", "\n")).alias("html"))


@register(f"""WITH p AS (SELECT page_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS paragraphs FROM ({PARAGRAPHS_SQL}) WHERE length(text) >= 10 GROUP BY page_id)
    SELECT page_id, CASE WHEN paragraphs > 0 THEN 'ok' WHEN coalesce(html, '') = '' THEN 'error: empty page' ELSE 'error: no paragraphs' END AS status,
        CASE WHEN paragraphs > 0 THEN regexp_replace(url, '^https?://', '') || '.txt' ELSE '' END AS out_text, coalesce(chars, 0) AS chars, coalesce(paragraphs, 0) AS paragraphs FROM pages LEFT JOIN p USING (page_id)""")
def extraction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of an extraction of all pages' paragraphs: file, result, characters and status."""
    pages = table(spark, sf_dir, "pages")
    found = extracted_paragraphs(pages).groupBy("page_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("paragraphs"))
    ok, empty = F.coalesce(F.col("paragraphs") > 0, F.lit(False)), tx.or_empty(F.col("html")) == ""
    return pages.join(found, "page_id", "left").select(
        "page_id", F.when(ok, "ok").when(empty, "error: empty page").otherwise("error: no paragraphs").alias("status"),
        F.when(ok, F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".txt"))).otherwise("").alias("out_text"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"),
    )


@register("""SELECT conv_id, turn, '{"text":"' || 'unit ' || conv_id || '.' || turn || '","doc_id":"' || conv_id || '","decision":"majority"}' AS target,
    CASE WHEN lag(turn) OVER w IS NULL THEN NULL ELSE 'unit ' || conv_id || '.' || lag(turn) OVER w END AS previous, CASE WHEN lead(turn) OVER w IS NULL THEN NULL ELSE 'unit ' || conv_id || '.' || lead(turn) OVER w END AS following
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def api_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as the service answers them; the decision is always majority, and a missing neighbour is null."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    unit = F.concat(F.lit("unit "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    target = F.to_json(F.struct(unit.alias("text"), F.col("conv_id").cast("string").alias("doc_id"), F.lit("majority").alias("decision")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", target.alias("target"), F.lag(unit).over(order).alias("previous"), F.lead(unit).over(order).alias("following"))


@register(f"""SELECT o_orderstatus AS court, o_orderpriority AS opinion, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:3] AS first FROM orders GROUP BY ALL""")
def test_case_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases by court and opinion, in the order of their keys; what the report lists of each."""
    rows = relational.quota(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], [F.col("o_orderkey").asc()], 3)
    first = rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.array_sort(F.collect_list("o_orderkey")).alias("first"))
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(first, ["o_orderstatus", "o_orderpriority"]).select(F.col("o_orderstatus").alias("court"), F.col("o_orderpriority").alias("opinion"), "n", "first")


@register("""SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'wrong dimension' END AS rejected, CAST(CASE WHEN vec_id % 10 = 0 THEN len(embedding) - 1 ELSE len(embedding) END AS INTEGER) AS dim FROM embeddings""")
def append_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may be appended and rows for quarantine: the dimension must be the table's."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    given = rows.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.slice("vec", F.lit(1), F.size("vec") - 1)).otherwise(F.col("vec")).alias("vec"))
    return cases.checked(given, F.size("vec") == dim, "wrong dimension").select("vec_id", "rejected", F.size("vec").alias("dim"))


@register(f"""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'Highlighted text cannot be empty' WHEN conv_id % 7 = 0 THEN 'User ID is required' END AS error, upper(substr(role, 1, 1)) || substr(role, 2) AS status, upper(regexp_extract('a.' || role, '\\.([^.]*)$', 1)) AS kind, role IN ('user', 'assistant') AS known FROM conversations""")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a blank text or without a user are refused; how status and file kind are shown; which labels are known."""
    text = F.when(F.col("turn") % 5 == 0, " \n").otherwise(F.concat(F.lit("x"), "text"))
    user = F.when(F.col("conv_id") % 7 == 0, "").otherwise("someone")
    error = F.when(tx.strip(text) == "", "Highlighted text cannot be empty").when(user == "", "User ID is required")
    status = F.concat(F.upper(F.substring("role", 1, 1)), F.substring(F.col("role"), F.lit(2), F.length("role")))
    kind = F.upper(F.regexp_extract(F.concat(F.lit("a."), "role"), r"\.([^.]*)$", 1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", error.alias("error"), status.alias("status"), kind.alias("kind"), F.col("role").isin("user", "assistant").alias("known"))


@register("""SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'Error: failed' ELSE event_type END AS summarization, event_type <> 'error' AS summarized FROM events""")
def highlight_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights as a stream: each is inserted without a summary, then updated with it or with the error; the latest state."""
    from casemill.streaming.ingest import upsert_highlights

    return upsert_highlights(spark, sf_dir)


_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_MARKDOWN = """'# Case ' || conv_id || chr(10) || chr(10) || '**Court:** Supreme Court of Testing' || chr(10) || '**Date:** March ' || (conv_id % 28 + 1) || ', 1999' || chr(10) || chr(10)
    || '## Headnotes' || chr(10) || '**[1] Note of ' || conv_id || '**' || chr(10) || chr(10) || 'In short.' || chr(10) || chr(10) || '## Sections' || chr(10)
    || string_agg('### Part ' || turn || chr(10) || chr(10) || substr(body, 1, 4000) || chr(10) || chr(10), '' ORDER BY turn)"""


@register(f"""SELECT conv_id, {_MARKDOWN} AS markdown, ['[1999] AC ' || conv_id, '[1999] UKSC ' || conv_id] AS citations, string_agg(body, ' ' ORDER BY turn) AS majority_opinion, count(*) AS parts
    FROM (SELECT conv_id, turn, {_FLAT.format('text')} AS body FROM {_DENSE}) WHERE body <> '' GROUP BY conv_id""")
def publisher_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publisher's pages, made of conversations, read back and written as markdown."""
    from casemill.sources.publisher import publisher_cases

    rows = _dense(spark, sf_dir).where(tx.collapse(F.col("text")) != "").withColumn("id", F.col("conv_id").cast("string"))
    part = F.concat(F.lit('<h1 class="organization">Part '), F.col("turn").cast("string"), F.lit("</h1><div><p>"), tx.escape_markup(F.col("text")), F.lit("</p></div>"))
    whole = rows.groupBy("conv_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p"), "text"))), lambda x: x["p"]), "\n").alias("body"),
                                              F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.lit("").alias("p"), "text"))), lambda x: x["text"]), "\n").alias("all"))
    head = F.concat(F.lit('<html><head><title>Case '), "id", F.lit(', Court Opinion 7</title></head><body><div class="citation-group"><span class="cite">[1999] UKSC '), "id",
                    F.lit('</span><span class="cite">[1999] AC '), "id", F.lit('</span></div><div id="content_document"><center>Supreme Court of Testing</center><center>Decided March '),
                    (F.col("conv_id") % 28 + 1).cast("string"), F.lit(', 1999.</center><div class="headnotesContainer"><div class="headnote"><b class="headnoteSlug">Note of '), "id",
                    F.lit('</b><p class="headnote_text">In short.</p></div></div>'))
    pages = whole.select("conv_id", F.concat(head, "body", F.lit('<div class="end"></div></div></body></html>')).alias("html"),
                         F.concat(F.lit('<div id="contentMajOp">'), tx.escape_markup(F.col("all")), F.lit("</div>")).alias("opinion"))
    found = publisher_cases(pages, "conv_id")
    majority = publisher_cases(pages.select("conv_id", F.col("opinion").alias("html")), "conv_id").select("conv_id", "majority_opinion")
    written = jd.case_markdown(F.col("case_name"), F.col("court"), F.col("date"), F.col("headnotes"), F.col("sections"))
    return found.drop("majority_opinion").join(majority, "conv_id").select("conv_id", written.alias("markdown"), "citations", "majority_opinion", F.size("sections").cast("long").alias("parts"))


@register(r"""SELECT o_orderkey, 'Order of A & B' AS short_name, strftime(o_orderdate, '%B %-d, %Y') AS dated, o_orderpriority AS bare, 'x ' || o_orderkey AS cleaned FROM orders""")
def name_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names from titles or file stems, long dates, quotes off, and a paragraph without its numbers."""
    key = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Order of A & B  [1999] UKSC "), key)).otherwise(F.lit("A [1999]"))
    dated = F.concat(F.lit("Decided on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" at noon"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.short_case_name(F.lit("Order_of_A_&_B_[1999]_(2)"), title).alias("short_name"), tx.long_date(dated).alias("dated"),
        tx.strip_quotes(F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))).alias("bare"), tx.clean_paragraph(F.concat(F.lit(" 12. x  "), key)).alias("cleaned"),
    )


@register(r"""SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS chars FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''""")
def rechunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even chunks lose nothing but white space."""
    from casemill.operators.chunking import even_chunks

    chunks = even_chunks(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("paragraphs")))
    return chunks.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("chunk", r"\s", ""))).alias("chars"))


# ---- the build of a corpus -----------------------------------------------------------------------------------------


def _role_sql(column: str) -> str:
    said = f"trim(regexp_replace(substr({column}, 1, 400), '\\s+', ' ', 'g'))"
    return "CASE " + " ".join(f"WHEN regexp_matches({said}, '{pattern}') THEN '{role}'" for role, pattern in ROLE_WORDS) + " ELSE 'Reasoning' END"


_BUILD = f"""l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})), lambda x: length(x) >= 10) AS s FROM documents),
    p AS (SELECT doc_id, source, len(s) AS n, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS position FROM l),
    r AS (SELECT doc_id, source, text, position, doc_id % 3 <> 0 AND (n + 1) // 2 >= 3 AND position < (n + 1) // 2 AS kept FROM p),
    c AS (SELECT doc_id, source, text, position, kept, CASE WHEN kept THEN 'Facts' ELSE {_role_sql('text')} END AS role FROM r),
    z AS (SELECT *, unnest({_split_sql('text')}) AS s, generate_subscripts({_split_sql('text')}, 1) AS nth FROM c),
    u AS (SELECT doc_id, source, position, role AS paragraph_role, trim(replace(s, chr(1), '.'), {_WS}) AS text, nth FROM z WHERE length(trim(replace(s, chr(1), '.'), {_WS})) >= 10)"""


def _corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The build over all documents; an earlier one had classified the first half of each, and texts of every third have changed since."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = corpus.line_paragraphs(docs)
    half = lines.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where("position < int((n + 1) / 2)")
    before = half.select("doc_id", "position", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"), F.lit("Facts").alias("role"))
    names = docs.select("doc_id", F.concat(F.lit("In re "), "source").alias("short_name"), F.lit(None).cast("string").alias("year"), F.lit(None).cast("array<string>").alias("judges"))
    return corpus.build(spark, docs, names, fresh(spark, "corpus"), before)


@register(f"""WITH {_BUILD} SELECT u.doc_id, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.position, nth) - 1 AS sentence_index, u.position, u.text, {_role_sql('u.text')} AS role, paragraph_role, f.text AS summary,
    coalesce('In re ' || source, CAST(u.doc_id AS VARCHAR)) || '  Judges: Various. ' || replace(substr(u.text, 1, 100), chr(10), ' ') AS tag FROM u JOIN (SELECT doc_id, text FROM c WHERE position = 0) f ON f.doc_id = u.doc_id""")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with roles, context and summaries, built in stages; the earlier build's roles are kept where a document goes on."""
    found = _corpus(spark, sf_dir)["units"]
    return found.withColumns({"sentence_index": F.col("sentence_index").cast("long"), "position": F.col("position").cast("long")})


@register()
def corpus_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best sentences of other documents for the first sentence of every twentieth document, by each of the four variants."""
    units = _corpus(spark, sf_dir)["units"]
    queries = corpus.first_units(units).where("doc_id % 20 = 0")
    return corpus.comparisons(units, queries, HashingEmbedder())
