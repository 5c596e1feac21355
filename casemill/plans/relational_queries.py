"""Relational logic: exclusion, dedup, windows, joins, activity, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import text as tx
from casemill.operators import relational
from casemill.plans.registry import Registry
from casemill.plans.tables import table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

@register("SELECT p_partkey, p_partkey % 6 IN (0, 1, 3, 4) AS same FROM part")
def same_case_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one case: equal but for the file's ending, with and without citation, by ``&``, alike for 25 characters; others are not."""
    key, name = F.col("p_partkey"), F.concat(F.lit("Case of "), "p_name", F.lit(" and Others"))
    kind = key % 6
    a = (
        F.when(kind == 0, F.concat(name, F.lit(" [1983] IESC 3.xml"))).when(kind == 1, F.concat(name, F.lit(" [1982] UKHL 3.xml")))
        .when(kind == 2, "").when(kind == 3, F.concat(name, F.lit(" & Co.xml"))).when(kind == 4, F.concat(F.lit("The Commissioners of Revenue "), name)).otherwise(F.concat(F.lit("X"), key.cast("string"), F.lit(" v Y")))
    )
    b = (
        F.when(kind == 0, F.concat(name, F.lit("  [1983]  IESC 3"))).when(kind == 1, F.upper(name)).when(kind == 2, name).when(kind == 3, F.concat(name, F.lit(" and co")))
        .when(kind == 4, "The Commissioners of Revenue of Kent").otherwise(F.concat(F.lit("Z"), key.cast("string"), F.lit(" v W")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", tx.same_case(a, b).alias("same"))


@register("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) <> (SELECT lower(trim(p_name)) FROM part ORDER BY p_partkey LIMIT 1) AND NOT starts_with(lower(p_name), 'part 1')")
def strict_case_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    source = parts.agg(F.min_by("p_name", "p_partkey")).first()[0] or ""
    name = F.col("p_name")
    own = (tx.case_name(name) == tx.case_name(F.lit(source))) & F.lit(source != "")
    return parts.where(~F.coalesce(own, F.lit(False)) & ~F.startswith(F.lower(tx.or_empty(name)), F.lit("part 1"))).select("p_partkey", "p_name")


@register("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    # the first of each (source, text): an aggregate, which is combined before the shuffle, gives what the window would;
    # a text travels as its SHA-256 digest
    return docs.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@register("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY source, substr(text, 1, 2000)")
def prefix_dedup_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's key: source and the first 2000 characters."""
    keys = [F.col("source"), F.substring("text", 1, 2000)]
    return table(spark, sf_dir, "documents").groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


@register("SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM documents GROUP BY source, substr(text, 1, 500))")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_report(table(spark, sf_dir, "documents"), [F.col("source"), F.substring("text", 1, 500)])


@register("""SELECT o_orderkey, o_orderstatus, year, CAST(place AS INTEGER) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS kept FROM (
    SELECT o_orderkey, o_orderstatus, year(o_orderdate) AS year, row_number() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate) DESC, o_orderkey) AS place FROM orders) WHERE place <= 50""")
def quota_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    kept = relational.quota(orders, ["o_orderstatus"], [F.col("year").desc(), F.col("o_orderkey").asc()], 50)
    return kept.withColumn("kept", F.count(F.lit(1)).over(Window.partitionBy("o_orderstatus")))


@register("""SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS sticky, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS carried
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def sticky_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    part, order = ["user_id"], ["ts", "event_id"]
    kind = F.col("event_type")
    return events.select(
        "event_id", relational.sticky(kind == "error", part, order).alias("sticky"), relational.carried(F.when(kind == "signup", F.col("event_id")), part, order).alias("carried")
    )


@register("""SELECT conv_id, turn, last_value(CASE WHEN length(text) >= 200 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS nearest_before,
    first_value(CASE WHEN length(text) >= 200 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS nearest_after FROM conversations""")
def nearest_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("at", F.col("turn"))
    return relational.nearest(rows, "conv_id", "turn", "at", F.length("text") >= 200, 14).select("conv_id", "turn", "nearest_before", "nearest_after")


@register("""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n, length(trim(text, ' ' || chr(10))) >= 50 AS ok FROM conversations)
    SELECT conv_id, CAST(min(p) FILTER (ok AND p >= least(3, n - 1) AND p < least(3, n - 1) + 10) AS BIGINT) AS begin_at,
    CAST(coalesce(max(p) FILTER (ok AND p < n // 2 AND p >= n // 2 - 19), min(p) FILTER (ok AND p >= n // 2 AND p < n // 2 + 20)) AS BIGINT) AS middle_at,
    CAST(max(p) FILTER (ok AND p >= n // 2 AND p <= n - 4) AS BIGINT) AS end_at FROM p GROUP BY conv_id""")
def test_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = relational.test_picks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return picks.select("conv_id", *[F.col(c).cast("long") for c in ("begin_at", "middle_at", "end_at")])


_HALF = "CAST(ceil(length(text) / 200.0) AS BIGINT)"


@register(f"""WITH s AS (SELECT conv_id, turn, {_HALF} AS n, sum({_HALF}) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
    t AS (SELECT conv_id, CAST(unnest(generate_series(0, CAST(max(upto) + 2 AS BIGINT))) AS BIGINT) AS slot FROM s GROUP BY conv_id)
    SELECT t.conv_id, t.slot, s.turn FROM t LEFT JOIN s ON s.conv_id = t.conv_id AND t.slot >= s.upto - s.n AND t.slot < s.upto""")
def sentence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence slots to paragraphs by running counts; slots beyond the last have none."""
    n = F.ceil(F.length("text") / 200.0).cast("long")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    slots = rows.withColumn("upto", upto).where("n > 0").select("conv_id", "turn", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("slot"))
    totals = rows.groupBy("conv_id").agg(F.sum("n").alias("total"))
    wanted = totals.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") + 2)).alias("slot"))
    return wanted.join(slots, ["conv_id", "slot"], "left").select("conv_id", "slot", "turn")


@register("""SELECT doc_id, (SELECT coalesce(max(doc_id) + 1, 0) FROM labels) + row_number() OVER (ORDER BY doc_id) - 1 AS next_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not yet there, numbered on from the largest index."""
    labels = table(spark, sf_dir, "labels")
    start = labels.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
    fresh = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left_anti")
    return relational.numbered(fresh, "doc_id", start).select("doc_id", F.col("number").alias("next_index"))


@register("""SELECT (SELECT count(*) FROM documents) AS extracted, (SELECT count(*) FROM labels) AS classified, count(*) AS missing, list(doc_id ORDER BY doc_id)[1:10] AS listed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    missing = docs.exceptAll(labels)
    listed = missing.orderBy("doc_id").limit(10).agg(F.array_sort(F.collect_list("doc_id")).alias("listed"))
    counts = docs.agg(F.count(F.lit(1)).alias("extracted")).crossJoin(labels.agg(F.count(F.lit(1)).alias("classified"))).crossJoin(missing.agg(F.count(F.lit(1)).alias("missing")))
    return counts.crossJoin(listed)  # single rows


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM labels")
def row_merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "labels").where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit("new").alias("origin"))
    return old.join(new, "doc_id", "left_anti").unionByName(new)


@register("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'Unknown ' || p_partkey ELSE 'Short ' || (p_partkey // 5 * 5) END AS short_name,
    CASE WHEN p_partkey % 5 = 4 THEN '' ELSE CAST(1900 + p_partkey // 5 % 100 AS VARCHAR) END AS year FROM part WHERE p_partkey // 5 * 5 IN (SELECT p_partkey FROM part)""")
def metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, by underscored stem, by the name before the bracket; else defaults."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    group = F.floor(F.col("p_partkey") / 5) * 5
    case = F.concat(F.lit("Case "), F.col("g").cast("string"), F.lit(" v X"))
    known = parts.where("p_partkey % 5 = 0").withColumn("g", F.col("p_partkey"))
    whole = F.concat(case, F.lit(" [1974] IR 284"))
    meta = known.select(F.when(F.col("g") % 2 == 0, whole).otherwise(F.replace(whole, F.lit(" "), F.lit("_"))).alias("key"), F.concat(F.lit("Short "), F.col("g").cast("string")).alias("short_name"),
                        (F.floor(F.col("g") / 5) % 100 + 1900).cast("string").alias("year"), case.alias("before"))
    kind = F.col("p_partkey") % 5
    name = F.when(kind < 2, whole).when(kind < 4, F.concat(case, F.lit(" [1999] X"))).otherwise(F.concat(F.lit("Unknown "), F.col("p_partkey").cast("string"), F.lit(" [2000] Y")))
    docs = parts.withColumn("g", group).join(known.select("g"), "g", "left_semi").select("p_partkey", name.alias("doc_id"))
    before = tx.strip(F.substring_index("doc_id", "[", 1))
    docs = docs.withColumns({"stem": F.replace("doc_id", F.lit(" "), F.lit("_")), "before": before})
    by_name = meta.groupBy("before").agg(F.min(F.struct("key", "short_name", "year")).alias("c"))
    a = meta.select(F.col("key").alias("doc_id"), F.struct("key", "short_name", "year").alias("a"))
    b = meta.select(F.col("key").alias("stem"), F.struct("key", "short_name", "year").alias("b"))
    found = docs.join(a, "doc_id", "left").join(b, "stem", "left").join(by_name, "before", "left").withColumn("m", F.coalesce("a", "b", "c"))
    return found.select("p_partkey", F.coalesce("m.short_name", "before").alias("short_name"), F.coalesce("m.year", F.lit("")).alias("year"))


_WS = "' ' || chr(10) || chr(9) || chr(13)"


def _name_sql(column: str) -> str:
    """A case name for comparison, in SQL."""
    bare = f"lower(regexp_replace(replace(trim(trim({column}, {_WS}), '()'), '.xml', ''), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(replace({bare}, '&', ' and '), '\\s+', ' ', 'g'))"


_RESOLVED = """SELECT target, t, list_slice(string_split(t, ' '), 1, 5) AS words, string_split(t, ' ')[1] AS w FROM (SELECT target, {t} AS t FROM (SELECT DISTINCT target FROM targets))"""


@register(f"""WITH targets AS (SELECT substr(text, 1, CAST(8 + doc_id % 40 AS INTEGER)) AS target FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT substr(text, 1, 60) FROM benchmark),
    t AS ({_RESOLVED.format(t=_name_sql('target'))}), c AS (SELECT doc_id AS rank, name, {_name_sql('name')} AS c FROM (SELECT doc_id, substr(text, 1, 50) || '.xml' AS name FROM documents)),
    m AS (SELECT target, name, rank, CASE WHEN t = c THEN 1 WHEN length(t) >= 8 AND (starts_with(c, substr(t, 1, 30)) OR length(c) >= 8 AND starts_with(t, substr(c, 1, 30))) THEN 2
        WHEN w = string_split(c, ' ')[1] AND len(list_filter(words, lambda x: contains(c, x))) >= 2 THEN 3 END AS tier FROM t, c)
    SELECT target, arg_min(name, rank) AS matched, CAST(arg_min(tier, rank) AS INTEGER) AS tier FROM m WHERE tier IS NOT NULL GROUP BY target""")
def fuzzy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-off beginnings of every fifth document and of all benchmark items, resolved to the documents' file names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = docs.where("doc_id % 5 = 0").select(F.substring("text", F.lit(1), (F.lit(8) + F.col("doc_id") % 40).cast("int")).alias("target"))
    targets = own.unionByName(table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 60).alias("target")))
    names = docs.select(F.concat(F.substring("text", 1, 50), F.lit(".xml")).alias("name"), F.col("doc_id").alias("rank"))
    return relational.resolve_names(targets, names)


_CORE = "trim(regexp_replace(regexp_replace({0}, '\\s*\\[\\d{{4}}\\][^\\]]*\\]?\\s*', ' ', 'g'), '\\s+', ' ', 'g'))"


@register(f"""WITH l AS (SELECT source, a, {_CORE.format('a')} AS x FROM (SELECT source, {_name_sql('source')} AS a FROM (SELECT DISTINCT substr(text, 1, CAST(4 + item_id % 9 AS INTEGER)) || CASE WHEN item_id % 2 = 0 THEN ' [1999] AC ' || item_id ELSE '' END AS source FROM benchmark))),
    r AS (SELECT name, b, {_CORE.format('b')} AS y FROM (SELECT name, {_name_sql('name')} AS b FROM (SELECT DISTINCT substr(text, 1, 40) || CASE WHEN doc_id % 3 = 0 THEN ' [2001] UKSC 4' ELSE '' END AS name FROM documents)))
    SELECT source, count(*) AS n, min(name) AS first FROM l, r WHERE source <> '' AND name <> '' AND (a = b OR x <> '' AND y <> '' AND (contains(y, x) OR contains(x, y) OR length(x) >= 10 AND length(y) >= 10 AND substr(x, 1, 25) = substr(y, 1, 25))) GROUP BY source""")
def same_case_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that short beginnings of the benchmark's items would exclude as their own case."""
    cited = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" [1999] AC "), F.col("item_id").cast("string"))).otherwise("")
    sources = table(spark, sf_dir, "benchmark").select(F.concat(F.substring("text", F.lit(1), (F.lit(4) + F.col("item_id") % 9).cast("int")), cited).alias("source"))
    names = table(spark, sf_dir, "documents").select(F.concat(F.substring("text", 1, 40), F.when(F.col("doc_id") % 3 == 0, " [2001] UKSC 4").otherwise("")).alias("name"))
    return relational.same_case_pairs(sources, names).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@register("""WITH g AS (SELECT unnest([CASE p_partkey % 4 WHEN 0 THEN 'Analogous' WHEN 1 THEN 'Not Analogous' WHEN 2 THEN 'Kinda Analogous' END, CASE WHEN p_size % 2 = 0 THEN 'Mostly Analogous' ELSE 'Analogous' END]) AS grade, unnest([p_partkey % 8 = 0, p_size % 3 = 0]) AS v FROM part)
    SELECT grade, count(*) AS n, count(*) FILTER (v) AS verbatim FROM g WHERE grade IS NOT NULL GROUP BY grade""")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, mark = F.col("p_partkey"), F.lit(" (Verbatim)")
    one = F.when(key % 8 == 0, F.concat(F.lit("Analogous"), mark)).when(key % 4 == 0, "Analogous ").when(key % 4 == 1, "Not Analogous").when(key % 4 == 2, " Kinda Analogous ")
    two = F.concat(F.when(F.col("p_size") % 2 == 0, "Mostly Analogous").otherwise("Analogous"), F.when(F.col("p_size") % 3 == 0, mark).otherwise(""))
    grid = table(spark, sf_dir, "part").select(key.alias("q"), one.alias("s1"), two.alias("s2")).unpivot("q", ["s1", "s2"], "slot", "cell").where("cell IS NOT NULL")
    grade = tx.strip(F.regexp_replace("cell", r"\(Verbatim\)", ""))
    return grid.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("cell", F.lit("Verbatim"))).alias("verbatim"))


_NOW = "2024-06-01 00:00:00"


@register(f"""SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN m < 1440 THEN m // 60 || CASE WHEN m // 60 = 1 THEN ' hour ago' ELSE ' hours ago' END
    WHEN m // 1440 = 1 THEN 'Yesterday' WHEN m < 10080 THEN m // 1440 || ' days ago' WHEN m < 43200 THEN m // 10080 || CASE WHEN m // 10080 = 1 THEN ' week ago' ELSE ' weeks ago' END
    ELSE m // 43200 || CASE WHEN m // 43200 = 1 THEN ' month ago' ELSE ' months ago' END END AS ago
    FROM (SELECT event_id, CAST(floor((epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events)""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.relative_time(F.col("ts"), F.lit(_NOW).cast("timestamp")).alias("ago"))


@register("SELECT user_id, event_id, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5 AND event_type IN ('click', 'purchase')")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest five of each user, and of those the wanted types: fewer than five may remain."""
    latest = relational.quota(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5)
    return latest.where(F.col("event_type").isin("click", "purchase")).select("user_id", "event_id", "place")


@register("""SELECT e.event_id, upper(substr(e.event_type, 1, 1)) || substr(e.event_type, 2) AS status, coalesce(d.source, 'Untitled') AS title FROM (SELECT * FROM events WHERE event_type IN ('view', 'click') AND user_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY ts DESC, event_id DESC LIMIT 5) e
    LEFT JOIN documents d ON d.doc_id = e.user_id""")
def queue_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), "source", "lang")
    mine = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).join(docs.where("lang = 'en'"), "user_id", "left_semi")
    latest = mine.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(5)
    return latest.join(docs, "user_id", "left").select("event_id", F.initcap("event_type").alias("status"), F.coalesce("source", F.lit("Untitled")).alias("title"))


@register("SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id")
def latest_highlight_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id"))
    return relational.latest_state(log, "user_id", "version", ["event_type", "value"])


@register("""SELECT 'eq' AS kind, count(*) AS n FROM documents WHERE source = 'src1' UNION ALL SELECT 'in', count(*) FROM documents WHERE lang IN ('en', 'de')
    UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM documents WHERE source = 'src2') UNION ALL SELECT 'limit', count(*) FROM (SELECT 1 FROM conversations LIMIT 7)""")
def table_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    either = docs.where("lang = 'fr'").select("doc_id").unionByName(docs.where("source = 'src2'").select("doc_id")).distinct()
    frames = {"eq": docs.where("source = 'src1'"), "in": docs.where(F.col("lang").isin("en", "de")), "either": either, "limit": table(spark, sf_dir, "conversations").limit(7)}
    counts = [frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, frame in frames.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


@register(r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_extract(url, '://[^/]+/([^/]+)/', 1) AS folder, substr(trim(regexp_replace(regexp_replace(url, '[\s:/–—\-]+', '_', 'g'), '[\x22''<>|?*]', '', 'g'), '_'), 1, 100) AS stem FROM pages")
def path_partition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(url, "^(https?)://", 1).alias("scheme"), F.regexp_extract(url, "://([^/]+)/", 1).alias("host"),
        F.regexp_extract(url, "://[^/]+/([^/]+)/", 1).alias("folder"), tx.file_stem(url).alias("stem"),
    )


@register("SELECT role, list_sort(list_distinct(list(turn))) AS turns, count(*) AS n FROM conversations GROUP BY role")
def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.array_sort(F.collect_set("turn")).alias("turns"), F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' v B' WHEN 1 THEN 'E v ' || p_name END AS cell FROM part")
def suggestion_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a row's first five cells that looks like a case's name."""
    kind = F.col("p_partkey") % 3
    cells = F.array(
        F.col("p_name"), F.when(kind == 1, F.concat(F.lit("x v "), F.repeat(F.lit("y"), 300))).otherwise("short"), F.when(kind == 0, F.concat("p_name", F.lit(" v B"))).otherwise("none"),
        F.when(kind == 1, F.concat(F.lit("E v "), "p_name")).otherwise("none"), F.lit("none"), F.lit("Sixth v Cell"),
    )
    named = F.filter(F.slice(cells, 1, 5), lambda c: F.contains(c, F.lit(" v ")) & (F.length(c) < 200))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(named, F.lit(0)).alias("cell"))


@register("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents by a seeded hash: the same ones in every run."""
    drawn = F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").orderBy(drawn, "doc_id").limit(20).select("doc_id")


@register("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ingested as a bounded stream, once each, into a table."""
    from casemill.streaming.ingest import ingest_events

    return ingest_events(spark, sf_dir)


@register("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ingested as a bounded stream, at most once each, with state that expires."""
    from casemill.streaming.ingest import recent_events

    return recent_events(spark, sf_dir)


@register("""SELECT event_id AS highlight_id, CASE event_type WHEN 'purchase' THEN 'purchase of ' || event_id WHEN 'error' THEN 'Error: error of ' || event_id ELSE CASE WHEN epoch_ms(ts) + 600000 < last - 300000 THEN 'Error: timed out' END END AS summarization,
    CAST(CASE event_type WHEN 'purchase' THEN 180000 WHEN 'error' THEN 60000 END AS BIGINT) AS after_ms
    FROM events, (SELECT max(epoch_ms(ts) + CASE event_type WHEN 'purchase' THEN 180000 WHEN 'error' THEN 60000 WHEN 'view' THEN 1800000 ELSE 0 END) AS last FROM events)""")
def highlight_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights through keyed state with timers: answered, failed, answered too late or never."""
    from casemill.streaming.ingest import event_highlights

    return event_highlights(spark, sf_dir)
