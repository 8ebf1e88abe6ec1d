"""The registered queries: every operator on the driver's tables, and SQL that gives the same rows.

Small doubles are rounded on both sides, arrays are joined to strings, and every top-k has a unique order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import clean, fuse, graph, parse, retrieve, route, stats, validate
from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with SQL for DuckDB if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- text -------------------------------------------------------------------------------------------------------------
LINES = "lines AS (SELECT doc_id AS doc, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"WITH {LINES} SELECT doc, idx, trim(regexp_replace(regexp_replace(line, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{{200b}}-\\x{{200f}}\\x{{ad}}\\x{{feff}}]', '', 'g'), '[ \\t]+', ' ', 'g')) AS line FROM lines")
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_lines(clean.lines_of(table(spark, sf, "documents")))


@query(f"WITH {LINES} SELECT doc, idx, line FROM lines WHERE NOT regexp_matches(line, '^\\s*[Tt]rang\\s+\\d+\\s*/\\s*\\d+\\s*$') AND NOT regexp_matches(line, '^\\s*-{{2,}}\\s*[Pp]age\\s+\\d+\\s*-{{2,}}\\s*$') AND NOT regexp_matches(line, '^\\s*\\d+\\s*$') AND NOT regexp_matches(line, '(?i)^\\s*(Người ký:|Email:.*?Cơ quan:|CÔNG BÁO/Số).*$')")
def drop_noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_noise(clean.lines_of(table(spark, sf, "documents")))


@query(f"WITH {LINES}, m AS (SELECT *, trim(line) = '' AS b, lag(trim(line) = '') OVER (PARTITION BY doc ORDER BY idx) AS pb FROM lines) SELECT doc, idx, CASE WHEN b THEN '' ELSE line END AS line FROM m WHERE NOT (b AND coalesce(pb, false))")
def collapse_blanks(spark: SparkSession, sf: str) -> DataFrame:
    return clean.collapse_blanks(clean.lines_of(table(spark, sf, "documents")))


@query(
    f"""WITH {LINES}, f AS (SELECT doc, idx, line, regexp_matches(line, '^\\s*\\S+\\.\\s*$') AS d, row_number() OVER w AS n, lead(line) OVER w AS nx FROM lines WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc ORDER BY idx)),
    g AS (SELECT *, (n - 1 - coalesce(max(CASE WHEN NOT d THEN n END) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS taken FROM f)
    SELECT doc, idx, CASE WHEN d AND nx IS NOT NULL THEN trim(line) || ' ' || trim(nx) ELSE line END AS line FROM g WHERE NOT taken UNION ALL SELECT doc, idx, line FROM lines WHERE trim(line) = ''"""
)
def merge_dangling_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The consumption of next lines, with one-word lines as the dangling ones, which the documents have."""
    return clean.merge_dangling(clean.lines_of(table(spark, sf, "documents")), dangles=lambda c: F.col(c).rlike(r"^\s*\S+\.\s*$"))


@query(f"WITH {LINES} SELECT doc, idx, min(CASE WHEN trim(line) <> '' THEN idx END) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_idx FROM lines")
def next_full_line(spark: SparkSession, sf: str) -> DataFrame:
    return clean.next_full_line(clean.lines_of(table(spark, sf, "documents"))).select("doc", "idx", "next_idx")


@query(f"WITH {LINES}, c AS (SELECT doc, idx, trim(line) AS line FROM lines), m AS (SELECT *, line = '' AS b, coalesce(lag(line = '') OVER (PARTITION BY doc ORDER BY idx), false) AS pb FROM c), k AS (SELECT doc, idx, line FROM m WHERE NOT (b AND pb)) SELECT doc, regexp_replace(string_agg(line, chr(10) ORDER BY idx), '^\\s+|\\s+$', '', 'g') || chr(10) AS text FROM k GROUP BY doc")
def format_documents(spark: SparkSession, sf: str) -> DataFrame:
    return clean.formatted(clean.lines_of(table(spark, sf, "documents")))



@query("SELECT doc_id, nfc_normalize(text) = text AS is_nfc FROM documents")
def is_nfc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.is_nfc("text").alias("is_nfc"))


@query("SELECT doc_id, replace(replace(replace(lower(strip_accents(text)), 'đ', 'd'), 'ß', 'ss'), 'ẞ', 'ss') AS folded FROM documents")
def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.fold("text").alias("folded"))


_STOP = "'" + "','".join(T.QUESTION_STOPWORDS) + "'"
_LEX = "'" + "','".join(T.LEXICAL_STOPWORDS) + "'"
_FOLD = "replace(replace(lower(strip_accents(text)), 'đ', 'd'), 'ß', 'ss')"
_TOKENS = f"list_filter(regexp_extract_all(replace(lower(strip_accents(text)), 'ß', 'ss'), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_LEX}))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({_FOLD}, '[a-z0-9]+')), lambda t: length(t) > 2 AND t NOT IN ({_STOP}))), ' ') AS tokens FROM documents")
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(T.token_set("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def lexical_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.lexical_tokens("text"), " ").alias("tokens"))


@query("SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) AS squeezed, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 2) // 3) END AS tokens, lower(trim(source)) IN ('', 'n/a', 'na', 'none', 'null', 'unknown', 'test', '...', 'n.a') AS placeholder, regexp_matches(text, '[\\pL\\pN]') AS has_alnum, regexp_replace(lower(source), '[^a-z0-9-]', '', 'g') AS slug FROM documents")
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.squeezed("text").alias("squeezed"), T.estimated_tokens("text").alias("tokens"), T.is_placeholder("source").alias("placeholder"), T.has_alnum("text").alias("has_alnum"), T.marker_slug("source").alias("slug"))


_IDS = "(SELECT o_orderkey, 'law_dieu-' || (o_orderkey % 60) || CASE WHEN o_custkey % 3 > 0 THEN '_khoan-' || (o_custkey % 9 + 1) ELSE '' END || CASE WHEN o_custkey % 3 = 2 THEN '_diem-' || CASE WHEN o_custkey % 2 = 0 THEN 'dd' ELSE 'b' END ELSE '' END || '_p' || o_custkey AS id FROM orders)"
_LOC = "'LD2024:A' || regexp_extract(id, '_dieu-(\\d+)', 1) || CASE WHEN regexp_matches(id, '_khoan-') THEN ':K' || regexp_extract(id, '_khoan-(\\d+)', 1) ELSE '' END || CASE WHEN regexp_matches(id, '_diem-dd') THEN ':Dđ' WHEN regexp_matches(id, '_diem-') THEN ':D' || regexp_extract(id, '_diem-([a-z]+)', 1) ELSE '' END"


def _node_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    clause = F.when(c % 3 > 0, F.concat(F.lit("_khoan-"), (c % 9 + 1).cast("string"))).otherwise("")
    point = F.when(c % 3 == 2, F.concat(F.lit("_diem-"), F.when(c % 2 == 0, "dd").otherwise("b"))).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("law_dieu-"), (F.col("o_orderkey") % 60).cast("string"), clause, point, F.lit("_p"), c.cast("string")).alias("id"))


@query(
    f"""WITH l AS (SELECT o_orderkey, {_LOC} AS locator FROM {_IDS}) SELECT o_orderkey, locator, '31/2024/qh15#' || regexp_extract(locator, ':A(\\d+)', 1) AS article_id,
    CASE WHEN locator LIKE '%:D%' THEN 'điểm ' || regexp_extract(locator, ':D(.)', 1) || ' ' ELSE '' END || CASE WHEN locator LIKE '%:K%' THEN 'khoản ' || regexp_extract(locator, ':K(\\d+)', 1) || ' ' ELSE '' END || 'Điều ' || regexp_extract(locator, ':A(\\d+)', 1) AS said,
    CASE WHEN locator LIKE '%:K%' THEN 1 ELSE 0 END + CASE WHEN locator LIKE '%:D%' THEN 1 ELSE 0 END AS depth, locator = 'LD2024:A7' OR locator LIKE 'LD2024:A7:%' AS related FROM l"""
)
def locators(spark: SparkSession, sf: str) -> DataFrame:
    l = _node_ids(spark, sf).select("o_orderkey", T.locator_of("id").alias("locator"))  # noqa: E741
    return l.select("o_orderkey", "locator", T.article_id("locator").alias("article_id"), T.locator_text("locator").alias("said"), T.locator_depth("locator").alias("depth"), T.related("locator", F.lit("LD2024:A7")).alias("related"))


# --- parsing ----------------------------------------------------------------------------------------------------------
_OUTLINE = """rows AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS idx, l_partkey, l_returnflag AS f, l_linestatus AS s FROM lineitem),
txt AS (SELECT doc, idx, CASE WHEN l_partkey % 7 = 0 THEN 'Chương IV' WHEN l_partkey % 7 = 1 THEN 'Mục ' || (l_partkey % 5 + 1) WHEN l_partkey % 7 = 2 THEN 'Điều ' || (l_partkey % 90 + 1) || '. Title ' || f WHEN l_partkey % 7 = 3 THEN (l_partkey % 9 + 1) || '. clause ' || s WHEN l_partkey % 7 = 4 THEN 'b) point ' || f WHEN l_partkey % 7 = 5 THEN 'đ) point ' || s ELSE 'plain text' END AS line FROM rows)"""


def _outline(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an outline, made of the line items of each order."""
    k = F.col("l_partkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    line = (
        F.when(k % 7 == 0, "Chương IV").when(k % 7 == 1, F.concat(F.lit("Mục "), (k % 5 + 1).cast("string"))).when(k % 7 == 2, F.concat(F.lit("Điều "), (k % 90 + 1).cast("string"), F.lit(". Title "), F.col("l_returnflag")))
        .when(k % 7 == 3, F.concat((k % 9 + 1).cast("string"), F.lit(". clause "), F.col("l_linestatus"))).when(k % 7 == 4, F.concat(F.lit("b) point "), F.col("l_returnflag"))).when(k % 7 == 5, F.concat(F.lit("đ) point "), F.col("l_linestatus"))).otherwise("plain text")
    )
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("idx"), line.alias("line"))


_CLASS = """cls AS (SELECT doc, idx, line, CASE WHEN line LIKE 'Chương%' THEN 'CHAPTER' WHEN line LIKE 'Mục%' THEN 'SECTION' WHEN line LIKE 'Điều%' THEN 'ARTICLE' WHEN regexp_matches(line, '^\\d+\\. ') THEN 'CLAUSE' WHEN regexp_matches(line, '^[a-zđ]\\) ') THEN 'POINT' END AS type,
CASE WHEN line LIKE 'Chương%' THEN 0 WHEN line LIKE 'Mục%' THEN 1 WHEN line LIKE 'Điều%' THEN 2 WHEN regexp_matches(line, '^\\d+\\. ') THEN 3 WHEN regexp_matches(line, '^[a-zđ]\\) ') THEN 4 END AS depth FROM txt)"""
_TREE = """m AS (SELECT *, coalesce(lead(idx) OVER (PARTITION BY doc ORDER BY idx), (SELECT 0)) AS nx FROM cls WHERE type IS NOT NULL),
up AS (SELECT c.doc, c.idx, c.type, c.depth, c.line, max(p.idx) AS parent_idx FROM m c LEFT JOIN m p ON p.doc = c.doc AND p.idx < c.idx AND p.depth < c.depth GROUP BY ALL)"""


@query(f"WITH {_OUTLINE}, {_CLASS} SELECT doc, idx, type, CASE WHEN type = 'POINT' THEN NULL WHEN type IS NOT NULL THEN CASE WHEN type = 'CHAPTER' THEN 'IV' ELSE regexp_extract(line, '(\\d+)', 1) END END AS number, CASE WHEN type = 'POINT' THEN line[1] END AS marker FROM cls")
def classify_lines(spark: SparkSession, sf: str) -> DataFrame:
    none = {"word_style": "string", "num_id": "int", "ilvl": "int", "num_fmt": "string", "number": "string", "marker": "string"}
    p = _outline(spark, sf).select("doc", F.col("idx").alias("index"), F.col("line").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return parse.classify(p).select("doc", F.col("index").alias("idx"), "match.type", "match.number", "match.marker")


@query(
    f"""WITH {_OUTLINE}, {_CLASS}, {_TREE} SELECT up.doc, up.idx AS start_idx, type, depth, parent_idx, row_number() OVER (PARTITION BY up.doc, parent_idx, type ORDER BY up.idx) AS position,
    coalesce((SELECT sum(length(t.line) + 1) FROM txt t WHERE t.doc = up.doc AND t.idx < up.idx), 0) AS char_start FROM up"""
)
def tree_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    none = {"word_style": "string", "num_id": "int", "ilvl": "int", "num_fmt": "string", "number": "string", "marker": "string"}
    p = _outline(spark, sf).select("doc", F.col("idx").alias("index"), F.col("line").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    t = parse.hierarchy(parse.boundaries(parse.classify(p)))
    return t.select("doc", "start_idx", "match.type", "depth", "parent_idx", "position", "char_start")


_SLUG = "CASE WHEN type = 'CHAPTER' THEN 'chuong-iv' WHEN type = 'SECTION' THEN 'muc-' || regexp_extract(line, '(\\d+)', 1) WHEN type = 'ARTICLE' THEN 'dieu-' || regexp_extract(line, '(\\d+)', 1) WHEN type = 'CLAUSE' THEN 'khoan-' || regexp_extract(line, '(\\d+)', 1) ELSE 'diem-' || CASE WHEN line[1] = 'đ' THEN 'dd' ELSE line[1] END END"


@query(
    f"""WITH RECURSIVE {_OUTLINE}, {_CLASS}, {_TREE}, s AS (SELECT *, {_SLUG} AS suffix FROM up), r AS (SELECT doc, idx, parent_idx AS up_idx, suffix AS path FROM s UNION ALL SELECT r.doc, r.idx, s.parent_idx, s.suffix || '_' || r.path FROM r JOIN s ON s.doc = r.doc AND s.idx = r.up_idx),
    ids AS (SELECT r.doc, r.idx, 'law_' || path || '_p' || coalesce((SELECT sum(length(t.line) + 1) FROM txt t WHERE t.doc = r.doc AND t.idx < r.idx), 0)::BIGINT AS id FROM r WHERE up_idx IS NULL)
    SELECT ids.id, s.type, p.id AS parent_id, s.doc::VARCHAR AS source_doc, coalesce(s.type = 'POINT' AND p.id LIKE '%!_dieu-%' ESCAPE '!' AND p.id NOT LIKE '%!_khoan-%' ESCAPE '!', false) AS implicit_parent,
    (SELECT count(*) FROM s c WHERE c.doc = s.doc AND c.parent_idx = s.idx) AS children_count FROM s JOIN ids USING (doc, idx) LEFT JOIN ids p ON p.doc = s.doc AND p.idx = s.parent_idx"""
)
def parsed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = parse.parse_text(_outline(spark, sf))
    return n.select("id", "type", "parent_id", "source_doc", F.coalesce("implicit_parent", F.lit(False)).alias("implicit_parent"), F.col("children_count").cast("long").alias("children_count"))


@query(f"WITH {_OUTLINE}, {_CLASS} SELECT type, count(*) AS n FROM cls WHERE type IS NOT NULL GROUP BY type")
def parse_stats(spark: SparkSession, sf: str) -> DataFrame:
    return parse.stats(parse.parse_text(_outline(spark, sf)))


# --- validation -------------------------------------------------------------------------------------------------------
def _part_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A synthetic tree: the parent of a part is its key divided by ten; the smallest are roots."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), F.when(k >= 10, F.floor(k / 10)).alias("parent_id"), F.when(k < 10, "CHAPTER").when(k < 100, "ARTICLE").when(k < 1000, "CLAUSE").otherwise("POINT").alias("type"), k.alias("start_idx"), F.when(k % 37 == 0, "").otherwise(F.col("p_name")).alias("text"), (k % 10).alias("position"), F.col("p_brand").alias("title"))


_PART = "(SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent_id, CASE WHEN p_partkey < 10 THEN 'CHAPTER' WHEN p_partkey < 100 THEN 'ARTICLE' WHEN p_partkey < 1000 THEN 'CLAUSE' ELSE 'POINT' END AS type, CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_name END AS text, p_partkey % 10 AS position, p_brand AS title FROM part)"



@query("SELECT o_orderkey::VARCHAR AS node_id, 'VAL-003' AS rule_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def broken_parents(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_acctbal > 0").select((-F.col("c_custkey")).alias("id"), F.lit(None).cast("long").alias("parent_id"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (-F.col("o_custkey")).alias("parent_id"))
    return validate.broken_parents(o.unionByName(c)).select("node_id", "rule_id")


@query(f"SELECT id::VARCHAR AS node_id, 'VAL-005' AS rule_id FROM {_PART} WHERE type IN ('CLAUSE', 'POINT') AND trim(text) = ''")
def empty_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return validate.empty_nodes(_part_tree(spark, sf)).select("node_id", "rule_id")


@query(f"SELECT id::VARCHAR AS node_id, 'VAL-002' AS rule_id FROM {_PART} WHERE id % 11 = 0 AND type <> 'CHAPTER'")
def orphan_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return validate.orphans(_part_tree(spark, sf).withColumn("parent_id", F.when(F.col("id") % 11 != 0, F.col("parent_id")))).select("node_id", "rule_id")


_RING = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 10 < 3 THEN c_custkey - c_custkey % 10 + (c_custkey % 10 + 1) % 3 WHEN c_custkey % 10 < 6 THEN c_custkey - 3 END AS parent_id FROM customer)"


@query(f"WITH RECURSIVE t AS {_RING}, w AS (SELECT id AS start, parent_id AS top, 1 AS n FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT w.start, t.parent_id, n + 1 FROM w JOIN t ON t.id = w.top WHERE t.parent_id IS NOT NULL AND n < 12 AND w.top <> w.start) SELECT DISTINCT start AS id FROM w WHERE top = start")
def cycle_nodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 10 < 3, k - k % 10 + (k % 10 + 1) % 3).when(k % 10 < 6, k - 3).alias("parent_id"))
    return validate.on_cycles(t)


@query("WITH k AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey + l_linenumber) % 4 > 0), g AS (SELECT l_orderkey, arg_min(l_linenumber, l_linenumber) AS lo, max(l_linenumber) AS hi FROM k GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT l_orderkey, unnest(generate_series(lo, hi)) AS n FROM g) SELECT l_orderkey AS parent, 'clause_' || n AS node_id FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = e.l_orderkey AND k.l_linenumber = e.n)")
def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "lineitem").where((F.col("l_partkey") + F.col("l_linenumber")) % 4 > 0)
    n = k.select(F.col("l_orderkey").alias("parent_id"), F.lit("CLAUSE").alias("type"), F.col("l_linenumber").cast("string").alias("number"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("string").alias("title"), F.col("l_linenumber").alias("start_idx"))
    return validate.sequence_gaps(n).select(F.regexp_extract("message", r"under (\d+)", 1).cast("long").alias("parent"), "node_id")


@query(f"WITH RECURSIVE t AS {_PART}, d AS (SELECT id FROM t WHERE id % 97 = 0 UNION SELECT t.id FROM d JOIN t ON t.parent_id = d.id) SELECT id FROM t WHERE id NOT IN (SELECT id FROM d)")
def cascade_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    t = _part_tree(spark, sf)
    issues = t.where("id % 97 = 0").select(F.lit("VAL-001").alias("rule_id"), F.col("id").alias("node_id"), F.lit("ERROR").alias("severity"), F.lit("x").alias("issue_type"), F.lit("x").alias("message"))
    return validate.quarantine(t, issues)[0].select("id")


@query("WITH e AS (SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)), t AS (SELECT count(*) AS n FROM orders) SELECT t.n AS total_nodes_received, t.n - e.n AS total_nodes_validated, e.n AS fatal_errors_count, 0::BIGINT AS warnings_count, round((1 - e.n / t.n) * 100, 2) AS structural_integrity_score FROM t, e")
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"))
    good = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("parent_id"))
    issues = o.join(good, "parent_id", "left_anti").select(F.lit("ERROR").alias("severity"))
    return validate.report(o, issues)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT p AND NOT s THEN 'missing_both' WHEN NOT p THEN 'missing_source' WHEN NOT s THEN 'missing_target' END AS reason FROM (SELECT *, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AS p, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) AS s FROM lineitem) WHERE NOT p OR NOT s")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import sinks

    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("p"), F.col("l_partkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"))
    n = table(spark, sf, "part").where("p_size < 25").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id")).unionByName(table(spark, sf, "supplier").where("s_acctbal > 1000").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id")))
    return sinks.ingest(n, e)[1].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason")



# --- graph ------------------------------------------------------------------------------------------------------------
@query("SELECT n_name AS source, r_name AS target, 'BELONG_TO' AS type FROM nation JOIN region ON n_regionkey = r_regionkey")
def belong_to_edges(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    return graph.belong_to(n.select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id"))).drop("implicit")


@query(
    """WITH n AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, lead(l_orderkey || '/' || l_linenumber || '/' || l_partkey) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_orderkey || '/' || l_linenumber || '/' || l_partkey) AS nx FROM lineitem)
    SELECT id AS source, nx AS target, 'NEXT' AS type FROM n WHERE nx IS NOT NULL UNION ALL SELECT nx, id, 'PREVIOUS' FROM n WHERE nx IS NOT NULL"""
)
def next_previous_edges(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("parent_id"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("start_idx"))
    return graph.sequential(n)


@query(f"WITH RECURSIVE t AS {_PART}, a AS (SELECT id, parent_id AS ancestor, 1 AS distance FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT a.id, t.parent_id, distance + 1 FROM a JOIN t ON t.id = a.ancestor WHERE t.parent_id IS NOT NULL) SELECT id, ancestor, distance FROM a")
def ancestor_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(_part_tree(spark, sf))


@query(f"WITH RECURSIVE t AS {_PART}, a AS (SELECT id, id AS top FROM t UNION ALL SELECT a.id, t.parent_id FROM a JOIN t ON t.id = a.top WHERE t.parent_id IS NOT NULL) SELECT a.id, top AS ancestor FROM a JOIN t ON t.id = top WHERE t.type = 'ARTICLE'")
def nearest_article(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nearest_ancestor(_part_tree(spark, sf), "ARTICLE")


@query(f"WITH RECURSIVE t AS {_PART}, a AS (SELECT id, parent_id AS top, 1 AS d FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT a.id, t.parent_id, d + 1 FROM a JOIN t ON t.id = a.top WHERE t.parent_id IS NOT NULL AND t.type <> 'ARTICLE'), l AS (SELECT a.id, d, '- ' || t.type || ': ' || t.title || ' - ' || t.text AS line FROM a JOIN t ON t.id = a.top) SELECT t.id, coalesce((SELECT string_agg(line, chr(10) ORDER BY d DESC) FROM l WHERE l.id = t.id), '') AS context FROM t")
def ancestor_context(spark: SparkSession, sf: str) -> DataFrame:
    return graph.context_path(_part_tree(spark, sf))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(1, greatest(0, (1 - (1 - least(1, l_discount * 5)) * (1 - l_tax)) * 0.9)), 4) AS confidence FROM lineitem")
def noisy_or(spark: SparkSession, sf: str) -> DataFrame:
    signals = F.array(F.col("l_discount") * 5, F.lit(None).cast("double"), F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", graph.confidence(signals, F.lit(0.9)).alias("confidence"))


@query("SELECT DISTINCT l_suppkey AS source, l_partkey AS target, 'MENTIONS' AS type FROM lineitem")
def mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mentions(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.col("l_partkey").alias("entity_id"))).drop("confidence")


@query("SELECT DISTINCT o_custkey, sha256('[\"' || o_custkey || '\",\"' || o_orderstatus || '\",\"' || 'HAS' || '\",\"\"]') AS edge_key FROM orders")
def edge_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("target"), F.lit("HAS").alias("type"))
    return o.select(F.col("source").alias("o_custkey"), graph.edge_key().alias("edge_key")).distinct()


# --- routing ----------------------------------------------------------------------------------------------------------
_SIGNALS = [(r"\bthe\b.*\bwith\b", "CROSS_REF", 1.0), (r"pour|dans", "EXCEPTION", 1.0), (r"\bder\b", "CONDITION", 0.4)]
_SCORE = "CASE WHEN regexp_matches(t, '\\bthe\\b.*\\bwith\\b') THEN 1.0 WHEN regexp_matches(t, 'pour|dans') THEN 1.0 WHEN regexp_matches(t, '\\bder\\b') THEN 0.4 ELSE 0.0 END"
_KIND = "CASE WHEN regexp_matches(t, '\\bthe\\b.*\\bwith\\b') THEN 'CROSS_REF' WHEN regexp_matches(t, 'pour|dans') THEN 'EXCEPTION' WHEN regexp_matches(t, '\\bder\\b') THEN 'CONDITION' ELSE 'NONE' END"


@query(f"SELECT doc_id, {_SCORE}::DOUBLE AS score, {_KIND} AS category FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def pattern_signal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", route.pattern_signal("text", _SIGNALS).alias("s")).select("doc_id", "s.score", "s.category")


@query(
    f"""WITH r AS (SELECT doc_id, lang, text, {_SCORE} AS s, {_KIND} AS k FROM (SELECT *, lower(text) AS t FROM documents))
    SELECT doc_id AS node_id, CASE WHEN lang = 'es' THEN 'RULE_ONLY' WHEN length(trim(text)) <= 5 THEN 'REJECT' WHEN s >= 0.85 THEN 'LLM_CANDIDATE' ELSE 'REJECT' END AS route,
    CASE WHEN lang = 'es' THEN 'STRUCTURAL_NODE' WHEN length(trim(text)) <= 5 THEN 'EMPTY_NODE' WHEN s >= 0.85 THEN k WHEN s > 0 THEN 'LOW_CONFIDENCE_' || k ELSE 'NO_TRIGGER' END AS reason FROM r"""
)
def route_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.when(F.col("lang") == "es", "CHAPTER").otherwise("CLAUSE").alias("type"), "text")
    return route.route(d, mode="EXP-A", signals=_SIGNALS).select("node_id", "route", "reason")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id, round(max({_COS}), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id < 8) b GROUP BY a.vec_id")
def anchor_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return route.anchor_scores(v, v.where("vec_id < 8"), "vec_id").select("vec_id", F.round("embed_score", 6).alias("score"))


@query(f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b ORDER BY {_COS} DESC, a.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id = 3").first()["embedding"]  # one vector
    return retrieve.vector_top(v, q, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


_SCORED = "(SELECT doc_id, quality AS label, round((n_chars % 1000) / 1000.0, 3)::DOUBLE AS p, round((doc_id % 97) / 97.0, 3)::DOUBLE AS e FROM labels JOIN documents USING (doc_id))"
_WAYS = "SELECT doc_id, label, unnest(['embed_only', 'average', 'weighted_0.7', 'weighted_0.3', 'max']) AS strategy, unnest([e, (p + e) / 2, 0.7 * p + 0.3 * e, 0.3 * p + 0.7 * e, greatest(p, e)]) AS score FROM s"
_SWEEP = f"WITH s AS {_SCORED}, w AS ({_WAYS}), t AS (SELECT unnest(generate_series(30, 100, 5)) / 100.0::DOUBLE AS threshold), c AS (SELECT strategy, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 0) AS tn, count(*) FILTER (score < threshold AND label = 1) AS fn FROM w, t GROUP BY ALL), m AS (SELECT *, tp + fp AS cost, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("label"), F.round((F.col("n_chars") % 1000) / 1000.0, 3).alias("pattern_score"), F.round((F.col("doc_id") % 97) / 97.0, 3).alias("embed_score"))


@query(f"WITH s AS {_SCORED} SELECT doc_id, strategy, round(score, 6) AS score FROM ({_WAYS})")
def fusion_strategies(spark: SparkSession, sf: str) -> DataFrame:
    return route.strategies(_scored(spark, sf)).select("doc_id", "strategy", F.round("score", 6).alias("score"))


@query(f"{_SWEEP} SELECT strategy, threshold, tp, fp, tn, fn, cost, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = route.sweep(route.strategies(_scored(spark, sf)), by=("strategy",))
    return s.select("strategy", "threshold", "tp", "fp", "tn", "fn", "cost", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_SWEEP} SELECT strategy, threshold, cost, round(recall, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY cost, recall DESC, precision DESC, threshold) AS n FROM m WHERE recall >= 0.5) WHERE n = 1")
def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    p = route.operating_point(route.sweep(route.strategies(_scored(spark, sf)), by=("strategy",)), 0.5, ("strategy",))
    return p.select("strategy", "threshold", "cost", F.round("recall", 6).alias("recall"))


@query(f"WITH s AS {_SCORED} SELECT count(*) FILTER (label = 1 AND e >= 0.5 AND doc_id % 5 > 0) AS tp, count(*) FILTER (label = 0 AND e >= 0.5 AND doc_id % 5 > 0) AS fp, count(*) FILTER (label = 1 AND NOT (e >= 0.5 AND doc_id % 5 > 0)) AS fn FROM s")
def routing_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    predicted = s.where("doc_id % 5 > 0").select(F.col("doc_id").alias("id"), (F.col("embed_score") >= 0.5).cast("int").alias("predicted"))
    return route.evaluate(s.select(F.col("doc_id").alias("id"), "label"), predicted).select("tp", "fp", "fn")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[cs]e|rights reserved') THEN 1 ELSE 0 END AS weak FROM documents")
def weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", route.weak_label("text", ["licen[cs]e", "rights reserved"]).alias("weak"))


# --- ontology ---------------------------------------------------------------------------------------------------------
RULES = [
    (0, "R_A", "SUBJECT", ["brass", "tin"], ["large"], "Metal", "C.METAL", "CORRECT", "HIGH", False),
    (1, "R_B", "SUBJECT", ["small"], [], "SmallObject", "C.SMALL", "FLAG", "HIGH", False),
    (2, "R_C", "ACTION", ["part"], [], "Item", "C.ITEM", "CORRECT", "HIGH", False),
    (3, "R_D", "OBJECT", ["1"], ["2"], None, None, "CORRECT", "LOW", False),
]
RULE_COLUMNS = "rule_no int, rule_id string, m6_type string, triggers array<string>, negative_triggers array<string>, subtype string, concept_id string, action string, confidence string, head_guard boolean"
_SQL_RULES = "(VALUES (0, 'R_A', 'SUBJECT', ['brass', 'tin'], ['large'], 'Metal', 'C.METAL', 'CORRECT', 'HIGH'), (1, 'R_B', 'SUBJECT', ['small'], [], 'SmallObject', 'C.SMALL', 'FLAG', 'HIGH'), (2, 'R_C', 'ACTION', ['part'], [], 'Item', 'C.ITEM', 'CORRECT', 'HIGH'), (3, 'R_D', 'OBJECT', ['1'], ['2'], NULL, NULL, 'CORRECT', 'LOW')) r(rule_no, rule_id, m6_type, trig, neg, subtype, concept_id, action, confidence)"
_ENT = "(SELECT p_partkey // 8 AS node_id, p_partkey % 8 AS pos, 'e' || (p_partkey % 5) AS id, CASE WHEN p_partkey % 13 = 0 THEN 'N/A' ELSE p_type || ' ' || p_name END AS text, CASE p_partkey % 6 WHEN 0 THEN 'SUBJECT' WHEN 1 THEN 'ACTION' WHEN 2 THEN 'OBJECT' WHEN 3 THEN 'CONDITION' WHEN 4 THEN 'PERMISSION' ELSE 'BOGUS' END AS entity_type, CASE WHEN p_partkey % 17 = 0 THEN '---' ELSE p_brand END AS evidence FROM part)"


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["SUBJECT", "ACTION", "OBJECT", "CONDITION", "PERMISSION", "BOGUS"]))
    return table(spark, sf, "part").select(
        F.floor(k / 8).alias("node_id"), (k % 8).alias("pos"), F.concat(F.lit("e"), (k % 5).cast("string")).alias("id"), F.when(k % 13 == 0, "N/A").otherwise(F.concat_ws(" ", "p_type", "p_name")).alias("text"),
        F.get(kinds, (k % 6).cast("int")).alias("entity_type"), F.when(k % 17 == 0, "---").otherwise(F.col("p_brand")).alias("evidence"),
    )


_ENT_OK = "o AS (SELECT *, CASE WHEN lower(text) IN ('n/a') THEN 'placeholder_text' WHEN entity_type = 'BOGUS' THEN 'invalid_type' WHEN evidence = '---' THEN 'invalid_evidence' END AS later FROM e), q AS (SELECT *, min(CASE WHEN later IS NULL THEN pos END) OVER (PARTITION BY node_id, id) AS f FROM o), w AS (SELECT *, CASE WHEN f IS NOT NULL AND pos > f THEN 'duplicate_id' ELSE later END AS reason FROM q)"


@query(f"WITH e AS {_ENT}, {_ENT_OK} SELECT node_id, pos, reason FROM w WHERE reason IS NOT NULL")
def entity_rejections(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ontology

    return ontology.entity_reasons(_entities(spark, sf)).where("reason is not null").select("node_id", "pos", "reason")


@query(f"WITH e AS {_ENT}, {_ENT_OK} SELECT reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY reason")
def rejection_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ontology

    return ontology.rejections(ontology.entity_reasons(_entities(spark, sf)))


@query(f"WITH e AS {_ENT}, {_SQL_RULES.replace('(VALUES', 'm AS (SELECT e.*, r.rule_id, r.rule_no FROM e LEFT JOIN (VALUES', 1)} ON m6_type = entity_type AND len(list_filter(trig, lambda t: contains(lower(text), t))) > 0 AND len(list_filter(neg, lambda t: contains(lower(text), t))) = 0) SELECT node_id, pos, arg_min(rule_id, rule_no) AS rule_id FROM m GROUP BY node_id, pos")
def rule_mapping(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ontology

    rules = spark.createDataFrame(RULES, RULE_COLUMNS)
    return ontology.match_rules(_entities(spark, sf), rules).select("node_id", "pos", "rule.rule_id")


@query(
    f"""WITH e AS {_ENT}, {_ENT_OK}, a AS (SELECT * FROM w WHERE reason IS NULL AND entity_type <> 'PERMISSION'), n AS (SELECT *, row_number() OVER (PARTITION BY node_id, entity_type ORDER BY pos) AS k FROM a),
    {_SQL_RULES.replace('(VALUES', 'm AS (SELECT n.*, r.* FROM n LEFT JOIN (VALUES', 1)} ON m6_type = entity_type AND len(list_filter(trig, lambda t: contains(lower(text), t))) > 0 AND len(list_filter(neg, lambda t: contains(lower(text), t))) = 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY node_id, pos ORDER BY rule_no) AS rn FROM m)
    SELECT node_id || '#' || entity_type || '#' || k AS mention_id, CASE WHEN rule_id IS NULL THEN 'VALID' WHEN (action = 'FLAG' OR confidence = 'LOW') AND entity_type = 'SUBJECT' AND contains(subtype, 'Object') THEN 'QUARANTINED' WHEN action = 'FLAG' OR confidence = 'LOW' THEN 'UNRESOLVED' WHEN subtype IS NOT NULL THEN 'CORRECTED' ELSE 'VALID' END AS status FROM b WHERE rn = 1"""
)
def mentions_normalized(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ontology

    rules = spark.createDataFrame(RULES, RULE_COLUMNS)
    return ontology.normalize_entities(ontology.filter_entities(_entities(spark, sf)), rules).select("mention_id", "status")


@query("SELECT item_id, text, scope FROM (SELECT l_orderkey * 10 + l_linenumber AS item_id, t AS text, CASE WHEN regexp_matches(t, '(luật|nghị định|thông tư|bộ luật)\\s+[^n]\\S*') THEN 'EXTERNAL_LAW' WHEN regexp_matches(t, 'điểm\\s+[a-zđ]\\s+khoản\\s+này|khoản\\s+\\d+\\s+điều\\s+này|khoản\\s+này|điều\\s+này') THEN 'SAME_ARTICLE' WHEN regexp_matches(t, 'điều\\s+\\d+') THEN 'SAME_DOCUMENT' ELSE 'AMBIGUOUS' END AS scope FROM (SELECT *, CASE l_partkey % 6 WHEN 0 THEN 'khoản ' || l_linenumber || ' điều này' WHEN 1 THEN 'điểm b khoản này' WHEN 2 THEN 'điều ' || l_suppkey WHEN 3 THEN 'luật đất đai điều ' || l_linenumber WHEN 4 THEN 'khoản 2 điều ' || l_suppkey ELSE 'mục lục' END AS t FROM lineitem))")
def reference_scopes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ontology

    k, n, s = F.col("l_partkey") % 6, F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    t = F.when(k == 0, F.concat(F.lit("khoản "), n, F.lit(" điều này"))).when(k == 1, "điểm b khoản này").when(k == 2, F.concat(F.lit("điều "), s)).when(k == 3, F.concat(F.lit("luật đất đai điều "), n)).when(k == 4, F.concat(F.lit("khoản 2 điều "), s)).otherwise("mục lục")
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), t.alias("text"))
    return rows.withColumn("scope", ontology.reference_scope(F.col("text"))["scope"])


# --- fusion -----------------------------------------------------------------------------------------------------------
_NORM = "n AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS f, list_sort(list_distinct(list(l_linestatus))) AS s, list_sort(list_distinct(list((l_linenumber)::VARCHAR))) AS k FROM lineitem GROUP BY l_orderkey)"


def _norm_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Each order a norm: return flags its subjects, line states its actions, line numbers its conditions."""
    li = table(spark, sf, "lineitem")
    core = li.select(F.col("l_orderkey").alias("norm_id"), F.col("l_orderkey").cast("string").alias("source_node_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"), F.lit("REQUIRE").alias("relation_type"))
    more = li.select(F.col("l_orderkey").alias("norm_id"), F.col("l_orderkey").cast("string").alias("source_node_id"), F.lit(None).cast("string").alias("source"), F.col("l_linenumber").cast("string").alias("target"), F.lit("HAS_CONDITION").alias("relation_type"))
    return core.unionByName(more)


@query(f"WITH {_NORM} SELECT array_to_string(f, ',') AS subjects, array_to_string(s, ',') AS actions, array_to_string(k, ',') AS conditions, count(*) AS n_sources, min(l_orderkey) AS first_norm FROM n GROUP BY f, s, k")
def norm_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    g = fuse.fuse_norms(fuse.norm_contents(_norm_relations(spark, sf)))
    return g.select(F.array_join("subject_ids", ",").alias("subjects"), F.array_join("action_ids", ",").alias("actions"), F.array_join("condition_ids", ",").alias("conditions"), F.size("source_norm_ids").cast("long").alias("n_sources"), F.array_min("source_norm_ids").alias("first_norm"))


@query(
    """WITH e AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS subject, event_type AS action, CASE event_id % 5 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'REQUIRE' WHEN 2 THEN 'PROHIBIT' END AS modality, event_id % 4 AS c, event_id % 7 = 0 AS x FROM events)
    SELECT p.id AS positive_id, n.id AS prohibit_id, p.modality || '_PROHIBIT' AS conflict_type, CASE WHEN p.x OR n.x THEN 'REVIEW_REQUIRED' WHEN p.c = n.c THEN 'POTENTIAL_LEGAL_CONFLICT' ELSE 'REVIEW_REQUIRED' END AS flag, CASE WHEN p.x OR n.x THEN 'EXCEPTION_SCOPE_REQUIRES_REVIEW' WHEN p.c = n.c THEN 'MATCHING_EXPLICIT_CONDITIONS' ELSE 'CONDITION_SCOPE_NOT_PROVEN_EQUAL' END AS context_status
    FROM e p JOIN e n ON p.subject = n.subject AND p.action = n.action AND p.modality IN ('ALLOW', 'REQUIRE') AND n.modality = 'PROHIBIT'"""
)
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    one = lambda c: F.array(c.cast("string"))
    none = F.array().cast("array<string>")
    n = table(spark, sf, "events").select(
        i.cast("string").alias("id"), F.when(i % 5 == 0, "ALLOW").when(i % 5 == 1, "REQUIRE").when(i % 5 == 2, "PROHIBIT").alias("modality"), one(F.col("user_id")).alias("subject_ids"), one(F.col("event_type")).alias("action_ids"),
        one(i % 4).alias("condition_ids"), F.when(i % 7 == 0, F.array(F.lit("x"))).otherwise(none).alias("exception_ids"), none.alias("object_ids"),
    )
    return fuse.conflicts(n).select("positive_id", "prohibit_id", "conflict_type", "flag", "context_status")


_OLD, _NEW = "(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 < 9)", "(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 > 0)"


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'ADDED' WHEN b.o_orderkey IS NULL THEN 'REMOVED' ELSE 'UPDATED' END AS change FROM {_OLD} a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snapshots(spark, sf)
    return fuse.diff(old, new, ("o_orderkey",))


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    return o.where(k % 10 < 9), o.where(k % 10 > 0).withColumn("o_totalprice", F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


@query(f"SELECT * FROM {_NEW}")
def delta_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The difference, applied to the old snapshot, gives the new one."""
    old, new = _snapshots(spark, sf)
    d = fuse.diff(old, new, ("o_orderkey",))
    return fuse.apply_delta(old, fuse.upserts(new, d, ("o_orderkey",)), d.where("change = 'REMOVED'"), ("o_orderkey",))


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS id, coalesce(b.o_totalprice, a.o_totalprice) AS price FROM {_OLD} a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey")
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import sinks

    old, new = (x.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")) for x in _snapshots(spark, sf))
    return sinks.upsert(old, new)



# --- statistics -------------------------------------------------------------------------------------------------------
_CAL = "(SELECT round((n_chars % 211) / 211.0, 2)::DOUBLE AS score, quality AS label FROM labels JOIN documents USING (doc_id))"


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.round((F.col("n_chars") % 211) / 211.0, 2).alias("score"), F.col("quality").alias("label"))


_ISO = f"p AS (SELECT score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {_CAL} GROUP BY score), r AS (SELECT score, pos, n, row_number() OVER w AS i, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM p WINDOW w AS (ORDER BY score)), m AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS m FROM r a JOIN r b ON b.i >= a.i), lo AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM m), v AS (SELECT k AS i, max(low) AS value FROM lo GROUP BY k)"


@query(f"WITH {_ISO} SELECT score, round(value, 8) AS value FROM r JOIN v USING (i)")
def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The value of the pooled block of each distinct score."""
    c = _calibration(spark, sf)
    fit = stats.isotonic_fit(c)
    return stats.isotonic_predict(c.select("score").distinct(), fit).select("score", F.round("calibrated", 8).alias("value"))


@query(f"WITH {_ISO} SELECT score, round(value, 8) AS value FROM r JOIN v USING (i)")
def isotonic_fit_by_windows(spark: SparkSession, sf: str) -> DataFrame:
    return stats.isotonic_fit_sql(_calibration(spark, sf)).select("score", F.round("value", 8).alias("value"))


_BINS = f"b AS (SELECT score, label, CASE WHEN score >= 0.9 THEN 9 WHEN score >= 0.8 THEN 8 WHEN score >= 0.7 THEN 7 WHEN score >= 0.6 THEN 6 WHEN score >= 0.5 THEN 5 WHEN score >= 0.4 THEN 4 WHEN score >= 0.3 THEN 3 WHEN score >= 0.2 THEN 2 WHEN score >= 0.1 THEN 1 ELSE 0 END AS bin FROM {_CAL})"


@query(f"WITH {_BINS} SELECT bin, count(*) AS n, round(avg(label), 8) AS accuracy, round(avg(score), 8) AS mean_confidence FROM b GROUP BY bin")
def confidence_bins(spark: SparkSession, sf: str) -> DataFrame:
    return stats.confidence_bins(_calibration(spark, sf)).select("bin", "n", F.round("accuracy", 8).alias("accuracy"), F.round("mean_confidence", 8).alias("mean_confidence"))


@query(f"WITH {_BINS}, g AS (SELECT bin, count(*) AS n, abs(sum(label) - sum(score)) AS gap FROM b GROUP BY bin) SELECT count(*) AS count, round(avg((score - label) * (score - label)), 6) AS brier_score, round((SELECT sum(gap) / sum(n) FROM g), 6) AS expected_calibration_error, round(count(*) FILTER (label = 1 AND score >= 0.8) / count(*) FILTER (score >= 0.8), 6) AS precision_at_threshold, round(count(*) FILTER (label = 1 AND score >= 0.8) / count(*) FILTER (label = 1), 6) AS recall_at_threshold FROM b")
def confidence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = stats.confidence(_calibration(spark, sf))
    return c.select("count", *[F.round(x, 6).alias(x) for x in ("brier_score", "expected_calibration_error", "precision_at_threshold", "recall_at_threshold")])


@query("SELECT count(*) AS count, count(*) FILTER (t = 1 AND q = 1) AS tp, count(*) FILTER (t = 0 AND q = 1) AS fp, count(*) FILTER (t = 1 AND q = 0) AS fn, count(*) FILTER (t = 0 AND q = 0) AS tn FROM (SELECT toxic AS t, 1 - quality AS q FROM labels)")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("toxic").cast("string").alias("expected"), (1 - F.col("quality")).cast("string").alias("predicted"))
    return stats.classification(rows, "1").select("count", "tp", "fp", "fn", "tn")


_REV = "(SELECT l_orderkey AS case_id, 'r' || l_linenumber AS reviewer, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2)"


@query(f"WITH v AS {_REV}, p AS (SELECT a.reviewer AS first, b.reviewer AS second, a.label AS x, b.label AS y FROM v a JOIN v b ON a.case_id = b.case_id AND a.reviewer < b.reviewer), n AS (SELECT first, second, count(*) AS n, count(*) FILTER (x = y) AS same FROM p GROUP BY 1, 2), l AS (SELECT first, second, x AS v, count(*) AS c FROM p GROUP BY ALL), r AS (SELECT first, second, y AS v, count(*) AS d FROM p GROUP BY ALL), e AS (SELECT first, second, sum(c * d) AS xy FROM l JOIN r USING (first, second, v) GROUP BY ALL) SELECT first, second, n, round((same / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM n JOIN e USING (first, second)")
def pairwise_kappa(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("reviewer")).agg(F.min("l_returnflag").alias("label"))
    return stats.pairwise_kappa(rows).select("first", "second", "n", F.round("kappa", 6).alias("kappa"))


@query("WITH l AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, text FROM conversations), a AS (SELECT doc, 0 AS s, max(idx) + 1 AS e FROM l GROUP BY doc), i AS (SELECT l.*, row_number() OVER (PARTITION BY l.doc ORDER BY idx) AS pos FROM l JOIN a ON a.doc = l.doc AND idx > s AND idx < e WHERE trim(text) <> '') SELECT doc, idx, round(greatest(0.30, 0.60 - 0.05 * (pos - 1)), 6)::DOUBLE AS confidence FROM i")
def clause_candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    p = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), n.alias("idx"), "text")
    a = p.groupBy("doc").agg((F.max("idx") + 1).alias("end_idx")).select("doc", F.lit("a").alias("article_id"), F.lit(0).alias("start_idx"), "end_idx")
    return stats.clause_candidates(p, a, "H2").select("doc", "idx", F.round("confidence", 6).alias("confidence"))


# --- retrieval --------------------------------------------------------------------------------------------------------
QUERY = ["the", "with", "pour", "tion", "erthhe"]
_BM = f"WITH d AS (SELECT doc_id, {_TOKENS} AS tk FROM documents), s AS (SELECT count(*) AS n, avg(len(tk)) AS al FROM d), q AS (SELECT unnest(['the', 'with', 'pour', 'tion', 'erthhe']) AS w), t AS (SELECT doc_id, w, len(tk) AS dl, len(list_filter(tk, lambda x: x = w)) AS tf FROM d, q), f AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM t GROUP BY w), c AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * greatest(1, dl) / greatest(1, al)))) AS sc FROM t JOIN f USING (w), s WHERE tf > 0 GROUP BY doc_id)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.lexical_tokens("text").alias("tokens"))


@query(f"{_BM} SELECT doc_id, round(sc, 6) AS lexical_score, round(sc / max(sc) OVER (), 6) AS score FROM (SELECT * FROM c ORDER BY sc DESC, doc_id LIMIT 20)")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    b = retrieve.bm25(_docs(spark, sf), QUERY, 20, id_col="doc_id")
    return b.select("doc_id", F.round("lexical_score", 6).alias("lexical_score"), F.round("score", 6).alias("score"))


@query(
    f"""{_BM}, lx AS (SELECT doc_id AS id, row_number() OVER (ORDER BY sc DESC, doc_id) AS place, 'LEXICAL' AS src FROM (SELECT * FROM c ORDER BY sc DESC, doc_id LIMIT 10)), v AS (SELECT a.vec_id AS id, {_COS} AS sc FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b ORDER BY 2 DESC, 1 LIMIT 10),
    u AS (SELECT id, place, src FROM lx WHERE place <= 4 UNION ALL SELECT id, 4 + row_number() OVER (ORDER BY sc DESC, id), 'VECTOR' FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM u) SELECT id, src AS retrieval_source FROM k WHERE n = 1 ORDER BY place LIMIT 10"""
)
def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    lexical = retrieve.bm25(_docs(spark, sf), QUERY, 10, id_col="doc_id").select(F.col("doc_id").alias("id"), "score")
    vector = retrieve.vector_top(v, v.where("vec_id = 3").first()["embedding"], 10, "vec_id").withColumnRenamed("vec_id", "id")
    return retrieve.merged(lexical, vector, 10, id_col="id").select("id", "retrieval_source")


_EDGES = "(SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem)"


@query(
    f"""WITH e AS (SELECT DISTINCT * FROM {_EDGES}), b AS (SELECT source AS a, target AS t, source || '|HAS|' || target AS k FROM e UNION ALL SELECT target, source, source || '|HAS|' || target FROM e),
    p1 AS (SELECT ['c7', t] AS n, [k] AS k, t AS top FROM b WHERE a = 'c7'), p2 AS (SELECT list_append(n, t) AS n, list_append(p1.k, b.k) AS k, t AS top FROM p1 JOIN b ON a = p1.top WHERE NOT list_contains(p1.k, b.k)) SELECT array_to_string(n, '>') AS path FROM p1 UNION ALL SELECT array_to_string(n, '>') FROM p2"""
)
def khop_paths(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("source"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("target"))
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"))
    e = o.unionByName(li).distinct().withColumn("type", F.lit("HAS"))
    return retrieve.neighbourhood(e, ["c7"], 2, 1_000_000).select(F.array_join("nodes", ">").alias("path"))




_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_\\pM]+'))"


@query(
    f"""WITH c AS (SELECT doc_id, source, text, CASE doc_id % 4 WHEN 0 THEN 'NORM' WHEN 1 THEN 'ANCHOR' WHEN 2 THEN 'CHILD' ELSE 'PARENT' END AS st FROM documents WHERE length(trim(text)) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY CASE st WHEN 'NORM' THEN 1.0 WHEN 'ANCHOR' THEN 0.9 WHEN 'CHILD' THEN 0.85 ELSE 0.8 END DESC, st, doc_id::VARCHAR) AS n FROM c),
    o AS (SELECT *, len(list_filter({_WORDS}, lambda w: w IN ('the', 'with', 'pour', 'der'))) / 4.0 AS ov FROM k WHERE n = 1) SELECT doc_id::VARCHAR AS node_id, round(0.35 * ov + 0.20 * ov + 0.10 * 0.25 + 0.10 * 0.5 + 0.10, 6)::DOUBLE AS rank_score FROM o ORDER BY 2 DESC, source, 1 LIMIT 12"""
)
def evidence_rank(spark: SparkSession, sf: str) -> DataFrame:
    d, i = table(spark, sf, "documents"), F.col("doc_id") % 4
    kind = F.when(i == 0, "NORM").when(i == 1, "ANCHOR").when(i == 2, "CHILD").otherwise("PARENT")
    c = None
    for s in ("NORM", "ANCHOR", "CHILD", "PARENT"):
        part = retrieve.candidates(d.where(kind == s).select(F.col("doc_id").cast("string").alias("node_id"), F.col("source").alias("canonical_locator"), "text", F.array(F.lit(s)).alias("roles")), s)
        c = part if c is None else c.unionByName(part)
    return retrieve.rank("the with pour der", c, 12).select("node_id", "rank_score")


@query("WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, greatest(1, (length(text) + 2) // 3) AS cost FROM conversations WHERE length(text) > 0), g AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, false AS kept FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT t.conv_id, t.i, CASE WHEN used + cost <= 120 THEN used + cost ELSE used END, used + cost <= 120 FROM g JOIN t ON t.conv_id = g.conv_id AND t.i = g.i + 1) SELECT conv_id, count(*) FILTER (kept) AS n_kept, max(used) AS used FROM g GROUP BY conv_id")
def budget_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """What a greedy pass over the turns of a conversation keeps within 120 tokens."""
    c = table(spark, sf, "conversations").where("length(text) > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.estimated_tokens("text").alias("cost")))).alias("t"))
    kept = c.withColumn("costs", F.transform("t", lambda x: x["cost"])).withColumn("kept", retrieve.within_budget(F.col("costs"), 120))
    return kept.select("conv_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate(F.transform("kept", lambda i: F.get("costs", i)), F.lit(0).cast("long"), lambda a, x: a + x).alias("used"))


@query("SELECT item_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, 'liệt kê|bao gồm những gì') THEN 'LIST_REQUEST' END, CASE WHEN regexp_matches(t, 'theo điều') THEN 'REFERENCE_REQUEST' END, CASE WHEN regexp_matches(t, 'ngoại lệ') THEN 'EXCEPTION_REQUEST' END, CASE WHEN regexp_matches(t, 'so sánh') THEN 'COMPARISON_REQUEST' END], lambda x: x IS NOT NULL), ',') AS signals FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'liệt kê theo điều' WHEN 1 THEN 'ngoại lệ và so sánh' WHEN 2 THEN 'bao gồm những gì' ELSE text END AS t FROM benchmark)")
def question_signals(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id") % 4
    t = F.when(i == 0, "liệt kê theo điều").when(i == 1, "ngoại lệ và so sánh").when(i == 2, "bao gồm những gì").otherwise(F.col("text"))
    q = table(spark, sf, "benchmark").select("item_id", t.alias("t"))
    return q.select("item_id", F.array_join(F.filter(retrieve.signals_of("t"), lambda s: s.isin("LIST_REQUEST", "REFERENCE_REQUEST", "EXCEPTION_REQUEST", "COMPARISON_REQUEST")), ",").alias("signals"))


@query("WITH p AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, '>' ORDER BY l_linenumber) AS steps FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1), d AS (SELECT steps, max(l_orderkey % 100) AS score FROM p GROUP BY 1) SELECT steps, score::DOUBLE AS score FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.steps LIKE d.steps || '>%')")
def path_prefix_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda x: x.cast("string")).alias("steps"))
    out = retrieve.without_prefixes(p.select("steps", (F.col("l_orderkey") % 100).cast("double").alias("score")))
    return out.select(F.array_join("steps", ">").alias("steps"), "score")


# --- queries that SQL does not express ---------------------------------------------------------------------------------
@query()
def question_context(spark: SparkSession, sf: str) -> DataFrame:
    """The whole retrieval for a question over a graph of documents, with a stub encoder: anchors to budgeted context.

    A row for each piece of evidence; the sections, in the order of their numbers, are the context.
    """
    from .. import services

    d = table(spark, sf, "documents").where("length(text) > 0")
    i = F.col("doc_id")
    n = d.select(
        F.concat(F.lit("law_dieu-"), F.floor(i / 10).cast("string"), F.when(i % 10 > 0, F.concat(F.lit("_khoan-"), (i % 10).cast("string"))).otherwise("")).alias("id"), F.when(i % 10 > 0, "CLAUSE").otherwise("ARTICLE").alias("type"),
        F.when(i % 10 > 0, F.concat(F.lit("law_dieu-"), F.floor(i / 10).cast("string"))).alias("parent_id"), (i % 10).cast("int").alias("position"), F.col("source").alias("title"), "text", i.cast("int").alias("start_idx"),
    )
    question = "the conditions with which pour der theo Điều 30"
    encoder = services.hashing_encoder()
    vectors = services.encoded(n, encoder, "id")
    out = retrieve.answer_context(question, n, vectors, encoder([question])[0])
    return out["included"].select("node_id", "canonical_locator", "source_type", "rank_score", "number", "estimated_tokens", "section")


# --- graph questions and probes ---------------------------------------------------------------------------------------
def _norm_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Norms, edges and terms made of the events: a norm an event, its user the subject and its type the action."""
    i = F.col("event_id")
    ev = table(spark, sf, "events")
    norms = ev.select(i.cast("string").alias("id"), F.when(i % 3 == 0, "ALLOW").when(i % 3 == 1, "REQUIRE").otherwise("PROHIBIT").alias("modality"), F.array(F.concat(F.lit("n"), (i % 50).cast("string"))).alias("source_node_ids"))
    each = F.array(F.struct(F.lit("HAS_SUBJECT").alias("type"), F.concat(F.lit("u"), "user_id").alias("target")), F.struct(F.lit("HAS_ACTION").alias("type"), F.col("event_type").alias("target")), F.struct(F.when(i % 4 > 0, "HAS_CONDITION").alias("type"), F.concat(F.lit("k"), (i % 9).cast("string")).alias("target")))
    edges = ev.select(i.cast("string").alias("source"), F.explode(each).alias("e")).select("source", "e.target", "e.type").where("type is not null")
    terms = edges.select(F.col("target").alias("id")).distinct().withColumn("canonical_text", F.concat(F.lit("term "), "id"))
    return norms, edges, terms


@query("SELECT event_id::VARCHAR AS norm_id, 'ALLOW' AS modality, 'term u' || user_id AS subject, 'term ' || event_type AS action FROM events WHERE event_id % 3 = 0 AND contains('term u' || user_id, 'u1') AND event_id % 4 > 0 AND contains('k' || event_id % 9, 'k3')")
def graph_statements(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import probes

    return probes.statements(*_norm_graph(spark, sf), subject="u1", modality="ALLOW", condition="k3")


@query("SELECT DISTINCT 'term k' || event_id % 9 AS part FROM events WHERE event_id % 4 > 0 AND contains('n' || event_id % 50, 'n4') AND contains(lower(event_type), 'a')")
def conditions_of_action(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import probes

    norms, edges, terms = _norm_graph(spark, sf)
    return probes.parts_of_action(norms, edges, terms.withColumn("canonical_text", F.when(F.col("id").rlike("^[uk][0-9]"), F.col("canonical_text")).otherwise(F.col("id"))), "a", "n4")


@query("WITH f AS (SELECT event_id::VARCHAR AS id, 'u' || user_id AS subject, event_type AS action, event_id % 3 AS m FROM events WHERE event_id % 4 = 0) SELECT DISTINCT a.subject, a.action, a.id AS first, b.id AS second FROM f a JOIN f b ON a.subject = b.subject AND a.action = b.action AND a.id < b.id AND a.m <> b.m")
def norm_collisions(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import probes

    norms, edges, _ = _norm_graph(spark, sf)
    return probes.collisions(norms, edges)


@query("""WITH f AS (SELECT event_id AS id, 'u' || user_id AS subject, event_type AS action, nm.modality FROM events JOIN (SELECT unnest(['ALLOW', 'REQUIRE', 'PROHIBIT']) AS modality, unnest([0, 1, 2]) AS m) nm ON event_id % 3 = m WHERE event_id % 4 = 0)
SELECT a.subject, a.action, a.modality AS first_modality, b.modality AS second_modality, count(DISTINCT a.id) AS n_first, count(DISTINCT b.id) AS n_second, count(*) AS n_pairs FROM f a JOIN f b ON a.subject = b.subject AND a.action = b.action AND a.modality < b.modality GROUP BY ALL""")
def collision_classes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import probes

    norms, edges, _ = _norm_graph(spark, sf)
    return probes.collision_classes(norms, edges)


@query("SELECT event_id::VARCHAR AS id, 'n' || event_id % 50 AS node FROM events WHERE event_id % 50 >= 40")
def ghost_pointers(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import probes

    nodes = spark.range(40).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    return probes.ghost_pointers(_norm_graph(spark, sf)[0], nodes)


@query(f"WITH RECURSIVE t AS {_PART}, s AS (SELECT * REPLACE (CASE WHEN id % 11 > 0 THEN parent_id END AS parent_id) FROM t), a AS (SELECT id, id AS top FROM s UNION ALL SELECT a.id, s.parent_id FROM a JOIN s ON s.id = a.top WHERE s.parent_id IS NOT NULL) SELECT id, type FROM s WHERE type IN ('CLAUSE', 'POINT') AND id NOT IN (SELECT a.id FROM a JOIN s ON s.id = a.top WHERE s.type = 'CHAPTER')")
def broken_branches(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import probes

    return probes.broken_branches(_part_tree(spark, sf).withColumn("parent_id", F.when(F.col("id") % 11 > 0, F.col("parent_id"))))
