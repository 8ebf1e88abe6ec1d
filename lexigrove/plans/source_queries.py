"""Registered queries of sources, sinks and model borders: rows of the tables go out in a format and come back in.

Files lie in the shared folder. The expected rows are those of the tables, so each query is a round trip against SQL.
"""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import services
from ..operators import clean, graph, parse, postings, retrieve, route, stats
from ..schemas import NODE
from ..session import shared_dir, table
from ..sources import loaders, sinks, versions
from .graph_queries import LAW, law
from .queries import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexigrove/{name}-{uuid.uuid4().hex}"


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file through the file system that Spark uses."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, True)
    out.write(bytearray(data))
    out.close()


# --- texts and documents ------------------------------------------------------------------------------------------------
_LINES = "t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name || ' ' || p_partkey END AS text FROM part)"


def _text_files(spark: SparkSession, sf: str) -> str:
    path, k = _folder(spark, "texts"), F.col("p_partkey")
    table(spark, sf, "part").select(F.when(k % 5 == 0, " ").otherwise(F.concat_ws(" ", "p_name", "p_partkey"))).write.text(path)
    return f"{path}/*.txt"


@query(f"WITH {_LINES} SELECT text, trim(text) = '' AS is_empty, true AS bare, count(*) AS n FROM t GROUP BY ALL")
def text_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = loaders.load(spark, _text_files(spark, sf))
    bare = F.coalesce("word_style", "number", "marker", F.col("num_id").cast("string")).isNull()
    return p.groupBy("text", "is_empty", bare.alias("bare")).agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT text, count(*) AS n FROM t GROUP BY ALL")
def legacy_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.text_lines(spark, _text_files(spark, sf)).groupBy("text").agg(F.count("*").alias("n"))


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_ROWS = """rn AS (SELECT r_regionkey AS r, row_number() OVER (ORDER BY r_regionkey) AS i, r_name FROM region), nn AS (SELECT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS j, n_nationkey, n_name FROM nation),
p AS (SELECT r * 1000 AS o, 'Heading1' AS style, r_name AS text, i::VARCHAR AS number, NULL AS marker, 0 AS ilvl, i || '. ' || r_name AS line FROM rn UNION ALL SELECT r * 1000 + j * 10, NULL, n_name || '; ', NULL, chr((96 + j)::INT), 1, chr((96 + j)::INT) || ') ' || n_name || '; ' FROM nn
UNION ALL SELECT r * 1000 + 900, NULL, '', NULL, NULL, NULL, '' FROM rn UNION ALL SELECT r * 1000 + 901, NULL, 'x ' || r_name, ['III', 'IV', 'V', 'VI', 'VII'][i], NULL, 0, ['III', 'IV', 'V', 'VI', 'VII'][i] || '. x ' || r_name FROM rn)"""


def _docx(spark: SparkSession, sf: str) -> str:
    """Regions as a numbered list, their nations as lettered items below, a blank, and a line of a Roman list that begins at three."""

    def p(text: str, style: str | None = None, num: int | None = None, level: int | None = None) -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
        return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text[:2]}</w:t></w:r><w:r><w:t>{text[2:]}</w:t></w:r></w:p>"

    nations = table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    body = ""
    for r in table(spark, sf, "region").orderBy("r_regionkey").collect():  # 5 rows
        body += p(r["r_name"], "Heading1", 1, 0) + "".join(p(f"{n['n_name']}; ", None, 1, 1) for n in nations if n["n_regionkey"] == r["r_regionkey"]) + p("") + p(f"x {r['r_name']}", None, 2, 0)
    level = lambda i, fmt, text, start=1: f'<w:lvl w:ilvl="{i}"><w:start w:val="{start}"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl>'
    lists = f'<w:abstractNum w:abstractNumId="7">{level(0, "decimal", "%1.")}{level(1, "lowerLetter", "%2)")}</w:abstractNum><w:abstractNum w:abstractNumId="8">{level(0, "upperRoman", "%1.", 3)}</w:abstractNum>'
    nums = '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f"<w:numbering {_NS}>{lists}{nums}</w:numbering>")
    path = _folder(spark, "docx") + "/a.docx"
    _write(spark, path, data.getvalue())
    return path


@query(f"WITH {_ROWS} SELECT row_number() OVER (ORDER BY o) - 1 AS place, text, style AS word_style, number, marker, ilvl, trim(text) = '' AS is_empty FROM p")
def docx_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.load(spark, _docx(spark, sf)).select(F.col("index").cast("long").alias("place"), "text", "word_style", "number", "marker", "ilvl", "is_empty")


@query(f"WITH {_ROWS} SELECT place, text, style AS word_style, ilvl FROM (SELECT *, row_number() OVER (ORDER BY o) - 1 AS place FROM p) WHERE trim(text) <> ''")
def docx_filled_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.filled_paragraphs(loaders.load(spark, _docx(spark, sf))).select(F.col("index").cast("long").alias("place"), "text", "word_style", "ilvl")


@query("SELECT p_partkey, repeat('M', k // 1000) || CASE k // 100 % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"])) + " END || CASE k // 10 % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"])) + " END || CASE k % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])) + " END AS roman, chr((97 + (k - 1) % 26)::INT) AS letter FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS k FROM part)")
def list_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers from 1 to 3999, as far as Roman numerals go."""
    k = F.col("p_partkey") % 3999 + 1
    return table(spark, sf, "part").select("p_partkey", loaders.roman(k).alias("roman"), loaders.number_text(F.lit("lowerLetter"), k).alias("letter"))


# --- tables in files ----------------------------------------------------------------------------------------------------
def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = law(spark, sf).withColumns({"start_idx": F.col("start_idx").cast("int"), "position": F.col("position").cast("int"), "number": F.col("number").cast("string")})
    have = set(n.columns)
    return n.select(*[(F.col(c.split()[0]) if c.split()[0] in have else F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in NODE.split(", ")])


@query(f"WITH {LAW} SELECT id, type, parent_id, title, text, position, number::VARCHAR AS number, start_idx FROM law")
def node_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "nodes")
    sinks.write_json(parse.checked_ids(_nodes(spark, sf)), path)
    return loaders.nodes(spark, path).select("id", "type", "parent_id", "title", "text", F.col("position").cast("long").alias("position"), "number", F.col("start_idx").cast("long").alias("start_idx"))


@query("SELECT p_partkey::VARCHAR AS node_id, p_name AS text, p_type AS entity_type, p_brand AS target FROM part")
def extraction_files(spark: SparkSession, sf: str) -> DataFrame:
    path, text = _folder(spark, "extractions"), F.lit(None).cast("string")
    entity = F.struct(F.lit("e").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("entity_type"), text.alias("evidence"))
    relation = F.struct(F.lit("e").alias("source"), F.lit("ALLOW").alias("relation_type"), F.col("p_brand").alias("target"), text.alias("source_status"), text.alias("evidence"))
    one = F.struct(F.col("p_partkey").cast("string").alias("node_id"), F.array(entity).alias("entities"), F.array(relation).alias("relations"))
    # a document a line, as the reader takes one a file
    rows = table(spark, sf, "part").groupBy(F.pmod(F.xxhash64("p_partkey"), F.lit(4)).alias("part")).agg(F.collect_list(one).alias("extracted_nodes"))
    rows.repartition(4, "part").write.partitionBy("part").json(path)
    return loaders.extractions(spark, f"{path}/part=*").select("node_id", F.col("entities")[0]["text"].alias("text"), F.col("entities")[0]["entity_type"].alias("entity_type"), F.col("relations")[0]["target"].alias("target"))


@query("SELECT 'node' AS kind, n_name AS a, NULL AS b FROM nation UNION ALL SELECT 'edge', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    path = _folder(spark, "graph")
    whole = n.agg(F.collect_list(F.struct(F.col("n_name").alias("id"))).alias("nodes"), F.collect_list(F.struct(F.col("n_name").alias("source"), F.col("r_name").alias("target"))).alias("edges"))
    whole.coalesce(1).write.json(path)
    nodes, edges = loaders.graph(spark, path)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("SELECT vec_id::VARCHAR AS node_id, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def embedding_store(spark: SparkSession, sf: str) -> DataFrame:
    path, v = _folder(spark, "vectors"), table(spark, sf, "embeddings")
    v.select(F.col("vec_id").cast("string").alias("node_id"), "embedding").write.parquet(path)
    size = v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return loaders.embeddings(spark, path, size["n"], size["d"]).select("node_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("SELECT doc_id::VARCHAR AS doc_id, round((doc_id % 89) / 89.0, 4)::DOUBLE AS score, quality AS label FROM labels WHERE doc_id % 3 > 0")
def calibration_files(spark: SparkSession, sf: str) -> DataFrame:
    path, k = _folder(spark, "gold"), F.col("doc_id")
    table(spark, sf, "labels").select("doc_id", F.round((k % 89) / 89.0, 4).alias("score"), F.col("quality").alias("label"), F.when(k % 3 > 0, "train").otherwise("test").alias("split")).write.csv(path, header=True)
    return loaders.calibration_rows(spark, path).select("doc_id", "score", "label")


@query("SELECT 0.5::DOUBLE AS threshold, round(avg(quality) FILTER (doc_id % 2 = 0), 8) AS value, count(*) FILTER (doc_id % 2 = 0) AS n FROM labels UNION ALL SELECT 1.0, round(avg(1) , 8), count(*) FILTER (doc_id % 2 = 1) FROM labels")
def calibrator_files(spark: SparkSession, sf: str) -> DataFrame:
    """A fit of two scores, of which the higher has only ones, kept and read again."""
    path, even = _folder(spark, "calibrator"), F.col("doc_id") % 2 == 0
    rows = table(spark, sf, "labels").select(F.when(even, 0.5).otherwise(1.0).alias("score"), F.when(even, F.col("quality")).otherwise(1).alias("label"))
    sinks.save_calibrator(stats.isotonic_fit(rows), path)
    return sinks.load_calibrator(spark, path).select("threshold", F.round("value", 8).alias("value"), "n")



@query("SELECT count(*) AS total_evaluated, count(*) FILTER (o_orderstatus = 'F') AS total_candidates FROM orders")
def route_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "routes")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("node_id"), F.when(F.col("o_orderstatus") == "F", "LLM_CANDIDATE").otherwise("REJECT").alias("route"))
    n = sinks.write_routes(o, path)
    read = spark.read.parquet(path).agg(F.count("*").alias("total_evaluated"))
    return read.where(F.col("total_evaluated") == n["total_evaluated"]).withColumn("total_candidates", F.lit(n["total_candidates"]).cast("long"))


@query(f"WITH {LAW} SELECT 'nodes' AS name, count(*) AS n FROM law UNION ALL SELECT 'metadata', 1 UNION ALL SELECT type, count(*) FROM (SELECT 'BELONG_TO' AS type FROM law WHERE parent_id IS NOT NULL) GROUP BY 1")
def graph_tables(spark: SparkSession, sf: str) -> DataFrame:
    path, n = _folder(spark, "graph"), law(spark, sf)
    sinks.write_graph(graph.graph_nodes(n.drop("start_idx", "number")), graph.belong_to(n), n.agg(F.count("*").alias("total_nodes")), path)
    size = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    edges = spark.read.parquet(f"{path}/edges").groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))
    return size(spark.read.parquet(f"{path}/nodes"), "nodes").unionByName(size(spark.read.json(f"{path}/metadata"), "metadata")).unionByName(edges)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderstatus AS law_code FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0")
def replaced_law(spark: SparkSession, sf: str) -> DataFrame:
    """One law's rows are replaced by half as many; the others stay."""
    path = _folder(spark, "laws")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("law_code"))
    sinks.replace_law(o, path)
    sinks.replace_law(o.where("law_code = 'F' and o_orderkey % 2 = 0").withColumn("price", F.col("price") + 1), path)
    return spark.read.parquet(path).select("o_orderkey", "price", F.col("law_code").cast("string").alias("law_code"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "answers")
    sinks.append_answers(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), path)
    sinks.append_answers(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price")), path)
    return spark.read.json(path)


@query("SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'HAS' AS type, max(l_quantity) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1, 2 UNION SELECT 'p' || l_partkey, 's' || l_suppkey, 'HAS', max(l_quantity) + 0 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_linenumber = 1 GROUP BY 1, 2")
def upserted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of first lines are there already; all are put in, of which those from a known part are taken, with their largest quantity."""
    li = table(spark, sf, "lineitem").select("l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("HAS").alias("type"), F.col("l_quantity").alias("quantity"))
    known = table(spark, sf, "part").where("p_size < 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).unionByName(li.select(F.col("target").alias("id")).distinct())
    old = li.where("l_linenumber = 1").drop("l_linenumber")
    return sinks.upsert_edges(old, li.drop("l_linenumber"), known).drop("edge_key")


@query("SELECT 'node' AS kind, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 2 ELSE 1 END AS v FROM orders WHERE o_orderkey % 5 <> 2 UNION ALL SELECT 'edge', o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN 2 ELSE 1 END FROM orders WHERE o_orderkey % 5 <> 2 AND o_orderkey + 5 < (SELECT count(*) FROM orders)")
def delta_transaction(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nodes, each with an edge to the fifth after it: some are new, some changed, some go with their edges."""
    return _as_rows(*sinks.apply_delta(*_ordered(spark, sf)))


def _ordered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(nodes, edges, delta) of the orders."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    top = o.count()
    node = lambda rest, v: o.where(k % 5 == rest).select(k.alias("id"), F.lit(v).alias("v"))
    edge = lambda rest, v: o.where((k % 5 == rest) & (k + 5 < top)).select(k.alias("source"), (k + 5).alias("target"), F.lit("NEXT").alias("type"), F.lit(v).alias("v"))
    both = lambda f, *rests: f(rests[0], 1) if len(rests) == 1 else f(rests[0], 1).unionByName(both(f, *rests[1:]))
    delta = {"added_nodes": node(0, 1), "updated_nodes": node(1, 2), "removed_nodes": node(2, 1), "added_edges": edge(0, 1), "updated_edges": edge(3, 2), "removed_edges": edge(2, 1)}
    return both(node, 1, 2, 3, 4), both(edge, 1, 2, 3, 4), delta


def _as_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("kind"), "id", "v").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), "v"))


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderkey + 5 < (SELECT count(*) FROM orders) AS has FROM orders)
SELECT 2 AS version, 'node' AS kind, k AS id, CASE WHEN k % 5 = 1 THEN 2 ELSE 1 END AS v FROM e WHERE k % 5 <> 2 UNION ALL SELECT 2, 'edge', k, CASE WHEN k % 5 = 3 THEN 2 ELSE 1 END FROM e WHERE k % 5 <> 2 AND has
UNION ALL SELECT 1, 'node', k, 1 FROM e WHERE k % 5 > 0 UNION ALL SELECT 1, 'edge', k, 1 FROM e WHERE k % 5 > 0 AND has""")
def graph_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The same delta committed to a graph kept in versions: both versions as they are read afterwards."""
    root = _folder(spark, "graph")
    nodes, edges, delta = _ordered(spark, sf)
    versions.create(root, nodes, edges, buckets=8)
    versions.commit(spark, root, delta, based_on=1)
    told = [_as_rows(*versions.read(spark, root, n)).select(F.lit(n).alias("version"), "kind", "id", "v") for n in (1, 2)]
    return told[0].unionByName(told[1])


# --- parsing, search and models --------------------------------------------------------------------------------------------
_WORDS = "list_filter(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('va', 'la', 'cua', 'co', 'duoc', 'thi', 'theo', 'nay', 'do', 'mot', 'nhung', 'cac', 'cho', 'tai', 'trong', 'khi', 've', 'voi', 'phai'))"


@query(f"""WITH n AS (SELECT p_partkey AS id, p_brand AS title, p_name AS text FROM part), d AS (SELECT id, {_WORDS} AS ts FROM n), s AS (SELECT count(*) AS docs, avg(len(ts)) AS a FROM d WHERE len(ts) > 0), q AS (SELECT unnest(['red', 'ring', 'brand']) AS t),
f AS (SELECT id, t, len(list_filter(ts, lambda x: x = t)) AS tf, len(ts) AS n FROM d, q), g AS (SELECT * FROM f WHERE tf > 0), k AS (SELECT t, count(*) AS df FROM g GROUP BY t)
SELECT id AS node_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / greatest(1, a)))), 6) AS lexical_score FROM g JOIN k USING (t), s GROUP BY id""")
def lexical_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes that have a token of the question, from postings that are made once and read twice."""
    path, n = _folder(spark, "lexical"), table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.col("p_name").alias("text"))
    key = route.content_hash(n, "text", "id")
    for _ in range(2):
        retrieve.lexical_index(n, path, key)
    return retrieve.bm25_indexed(spark, path, ["red", "ring", "brand", "red"], k=None).select("node_id", F.round("lexical_score", 6).alias("lexical_score"))


@query(f"""WITH n AS (SELECT p_partkey AS id, p_brand AS title, CASE WHEN p_partkey % 9 = 2 THEN p_name || ' red' WHEN p_partkey % 9 = 4 THEN '' ELSE p_name END AS text FROM part WHERE p_partkey % 9 <> 6), d AS (SELECT id, {_WORDS} AS ts FROM n), s AS (SELECT count(*) AS docs, avg(len(ts)) AS a FROM d WHERE len(ts) > 0), q AS (SELECT unnest(['red', 'ring', 'brand']) AS t),
f AS (SELECT id, t, len(list_filter(ts, lambda x: x = t)) AS tf, len(ts) AS n FROM d, q), g AS (SELECT * FROM f WHERE tf > 0), k AS (SELECT t, count(*) AS df FROM g GROUP BY t)
SELECT id AS node_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / greatest(1, a)))), 6) AS lexical_score FROM g JOIN k USING (t), s GROUP BY id""")
def lexical_changes_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same search on an index that was changed twice: texts replaced and emptied, nodes added late and removed."""
    path, k = _folder(spark, "postings"), F.col("p_partkey")
    parts = lambda name: table(spark, sf, "part").select(k.alias("id"), F.col("p_brand").alias("title"), name.alias("text"))
    postings.create(parts(F.col("p_name")).where("id % 9 <> 1"), path)
    postings.change(spark, path, parts(F.concat("p_name", F.when(k % 9 == 2, " ring ring").otherwise(""))).where("id % 9 in (1, 2)"))
    changed = F.when(k % 9 == 2, F.concat("p_name", F.lit(" red"))).otherwise("")
    postings.change(spark, path, parts(changed).where("id % 9 in (2, 4)"), parts(F.lit("")).where("id % 9 in (4, 6)").select("id"))
    return postings.top(spark, path, ["red", "ring", "brand", "red"], k=None).select("node_id", F.round("lexical_score", 6).alias("lexical_score"))


@query(f"WITH RECURSIVE {LAW}, up AS (SELECT id, parent_id AS a, 1 AS d FROM law WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, law.parent_id, d + 1 FROM up JOIN law ON law.id = up.a WHERE law.parent_id IS NOT NULL), l AS (SELECT up.id, string_agg('- ' || type || ': ' || title || ' - ' || text, chr(10) ORDER BY d DESC) AS c FROM up JOIN law ON law.id = a GROUP BY up.id) SELECT law.id AS node_id, 'Context:' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || 'Target:' || chr(10) || '- ' || type || ': ' || title || ' - ' || text AS prompt FROM law LEFT JOIN l ON l.id = law.id")
def model_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return services.prompts(law(spark, sf))


def _stub(prompt: str) -> dict:
    """A model for tests: it names the length of its prompt, and fails on long ones."""
    if len(prompt) > 160:
        raise RuntimeError("too long")
    return {"entities": [{"id": "e", "text": str(len(prompt)), "entity_type": "OBJECT", "evidence": "x"}], "relations": []}


@query(f"WITH RECURSIVE {LAW}, up AS (SELECT id, parent_id AS a, 1 AS d FROM law WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, law.parent_id, d + 1 FROM up JOIN law ON law.id = up.a WHERE law.parent_id IS NOT NULL), l AS (SELECT up.id, string_agg('- ' || type || ': ' || title || ' - ' || text, chr(10) ORDER BY d DESC) AS c FROM up JOIN law ON law.id = a GROUP BY up.id), p AS (SELECT law.id, k, length('Context:' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || 'Target:' || chr(10) || '- ' || type || ': ' || title || ' - ' || text) AS n FROM law LEFT JOIN l ON l.id = law.id) SELECT id AS node_id, CASE WHEN n <= 160 THEN n::VARCHAR END AS said FROM p WHERE k % 4 = 0")
def model_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """A model that fails on long prompts: those nodes get an empty extraction, after as many tries as there are."""
    n = law(spark, sf)
    routes = n.select(F.col("id").alias("node_id"), F.when(F.col("start_idx") % 4 == 0, "LLM_CANDIDATE").otherwise("REJECT").alias("route"))
    out = services.extracted(n, routes, services.with_retries(_stub, attempts=1, fallback=lambda e: services.EMPTY_EXTRACTION))
    return out.select("node_id", F.get(F.col("entities.text"), F.lit(0)).alias("said"))


@query("SELECT doc_id::VARCHAR AS node_id, length(text) AS n FROM documents")
def encoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """An encoder that gives the length of a text, kept by a hash of all texts, so that it is asked once."""
    d = table(spark, sf, "documents")
    key, path = route.content_hash(d, "text", "doc_id"), _folder(spark, "encoded")
    make = lambda: services.encoded(d, lambda texts: [[float(len(t))] for t in texts], "doc_id")
    for _ in range(2):
        found = route.cached(path, key, make, spark)
    return found.select("node_id", F.col("embedding")[0].cast("long").alias("n"))


@query("WITH s AS (SELECT user_id AS doc, event_id AS idx, CASE event_id % 5 WHEN 0 THEN '1.' WHEN 1 THEN 'b)' WHEN 2 THEN '' ELSE event_type END AS line FROM events), f AS (SELECT doc, idx, line, regexp_matches(line, '^\\s*(\\d+\\.|[a-zđA-ZĐ]\\))\\s*$') AS d, row_number() OVER w AS n, lead(line) OVER w AS nx FROM s WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc ORDER BY idx)), g AS (SELECT *, (n - 1 - coalesce(max(CASE WHEN NOT d THEN n END) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS taken FROM f) SELECT doc, idx, CASE WHEN d AND nx IS NOT NULL THEN trim(line) || ' ' || trim(nx) ELSE line END AS line FROM g WHERE NOT taken UNION ALL SELECT doc, idx, line FROM s WHERE trim(line) = ''")
def dangling_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and letters that stand alone take the next line, by the operator's own rule."""
    i = F.col("event_id")
    lines = table(spark, sf, "events").select(F.col("user_id").alias("doc"), i.alias("idx"), F.when(i % 5 == 0, "1.").when(i % 5 == 1, "b)").when(i % 5 == 2, "").otherwise(F.col("event_type")).alias("line"))
    return clean.merge_dangling(lines).select("doc", "idx", "line")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.4 ELSE 0.0 END::DOUBLE AS score, CASE l_partkey % 5 WHEN 0 THEN 'CROSS_REF' WHEN 1 THEN 'EXCEPTION' WHEN 2 THEN 'CONDITION' ELSE 'NONE' END AS category FROM lineitem")
def pattern_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The operator's own patterns, of which the strongest and then the first counts."""
    k = F.col("l_partkey") % 5
    t = F.when(k == 0, "Theo quy định tại khoản 1, trừ trường hợp").when(k == 1, "điều kiện, trừ khi").when(k == 2, "Trong trường hợp này").otherwise("không có gì")
    li = table(spark, sf, "lineitem").withColumn("t", t).withColumn("s", route.pattern_signal("t"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "s.score", "s.category")
