"""Registered queries of traversal, graph rows, validation and contexts, on a statute made of the part table.

Part p is the place k = p + 100: article k / 100, clause k / 10 % 10 and point k % 10, each if it is not zero. So places
have parents, locators, references to each other, and gaps, at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, references, retrieve, validate
from ..session import partitions, staged, table
from .queries import query

LETTERS = "abcdeghik"


def _id_sql(k: str) -> str:
    return (
        f"'law_dieu-' || ({k} // 100) || CASE WHEN {k} // 10 % 10 > 0 THEN '_khoan-' || ({k} // 10 % 10) ELSE '' END"
        f" || CASE WHEN {k} % 10 > 0 THEN '_diem-' || substr('{LETTERS}', ({k} % 10)::INT, 1) ELSE '' END"
    )


def _loc_sql(k: str) -> str:
    return (
        f"'LD2024:A' || ({k} // 100) || CASE WHEN {k} // 10 % 10 > 0 THEN ':K' || ({k} // 10 % 10) ELSE '' END"
        f" || CASE WHEN {k} % 10 > 0 THEN ':D' || substr('{LETTERS}', ({k} % 10)::INT, 1) ELSE '' END"
    )


LAW = f"""law AS (SELECT k, {_id_sql("k")} AS id, CASE WHEN k % 100 = 0 THEN 'ARTICLE' WHEN k % 10 = 0 THEN 'CLAUSE' ELSE 'POINT' END AS type,
  CASE WHEN k % 10 > 0 THEN {_id_sql("(k - k % 10)")} WHEN k % 100 > 0 THEN {_id_sql("(k - k % 100)")} END AS parent_id, k % 10 AS position, p_brand AS title,
  CASE k % 5 WHEN 0 THEN 'theo điểm b khoản 2 Điều ' || (k % 15 + 1) WHEN 1 THEN 'trừ trường hợp khoản 1 Điều ' || (k % 15 + 1) WHEN 2 THEN 'điều kiện là phải đăng ký'
  WHEN 3 THEN 'quyền và nghĩa vụ tại Điều ' || (k % 15 + 1) || ' và Điều 7' ELSE p_name END AS text, k AS start_idx, {_loc_sql("k")} AS locator, k // 100 AS number
  FROM (SELECT p_partkey + 100 AS k, * FROM part))"""


def _place(k: Column) -> Column:
    clause, point = F.floor(k / 10) % 10, (k % 10).cast("int")
    return F.concat(
        F.lit("law_dieu-"), F.floor(k / 100).cast("string"), F.when(clause > 0, F.concat(F.lit("_khoan-"), clause.cast("string"))).otherwise(""),
        F.when(point > 0, F.concat(F.lit("_diem-"), F.substring(F.lit(LETTERS), point, F.lit(1)))).otherwise(""),
    )


#: Places of the statute that a task takes.
PLACES = 20_000


def law(spark: SparkSession, sf: str) -> DataFrame:
    """The statute: (id, type, parent_id, position, title, text, start_idx, number), in partitions by its number of places.

    A place takes few bytes in its file but makes many in a task, so splits by the bytes of files are too large. A statute of
    several partitions is staged, since filters on what is made of a place would else be moved before the dealing.
    """
    part = table(spark, sf, "part")
    n = partitions(part.count(), PLACES)
    k = F.col("p_partkey") + 100
    article = (k % 15 + 1).cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("theo điểm b khoản 2 Điều "), article)).when(k % 5 == 1, F.concat(F.lit("trừ trường hợp khoản 1 Điều "), article)).when(k % 5 == 2, "điều kiện là phải đăng ký")
        .when(k % 5 == 3, F.concat(F.lit("quyền và nghĩa vụ tại Điều "), article, F.lit(" và Điều 7"))).otherwise(F.col("p_name"))
    )
    places = (part.repartition(n, "p_partkey") if n > 1 else part).select(
        _place(k).alias("id"), F.when(k % 100 == 0, "ARTICLE").when(k % 10 == 0, "CLAUSE").otherwise("POINT").alias("type"), F.when(k % 10 > 0, _place(k - k % 10)).when(k % 100 > 0, _place(k - k % 100)).alias("parent_id"),
        (k % 10).alias("position"), F.col("p_brand").alias("title"), text.alias("text"), k.alias("start_idx"), F.floor(k / 100).alias("number"),
    )
    return staged(places, "law") if n > 1 else places


ANCHORS = ["law_dieu-1", "law_dieu-2_khoan-3", "law_dieu-2_khoan-3_diem-b", "law_dieu-1_khoan-5_diem-a", "law_dieu-12_khoan-4", "law_dieu-1"]
_IN = "('" + "', '".join(ANCHORS) + "')"
#: The place of each anchor in the list, from zero.
_PLACES = "(VALUES " + ", ".join(f"('{a}', {i})" for i, a in enumerate(dict.fromkeys(ANCHORS))) + ") AS an(id, place)"


# --- traversal --------------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {LAW}, up AS (SELECT parent_id AS a, 1 AS d FROM law WHERE id IN {_IN} AND parent_id IS NOT NULL UNION ALL SELECT law.parent_id, d + 1 FROM up JOIN law ON law.id = up.a WHERE law.parent_id IS NOT NULL AND d < 3)
SELECT law.id, min(d) AS graph_distance FROM up JOIN law ON law.id = a GROUP BY law.id ORDER BY 2, 1 LIMIT 30""")
def anchor_parents(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.parents(law(spark, sf), ANCHORS).select("id", "graph_distance")


@query(f"WITH {LAW} SELECT id, parent_id, text FROM law WHERE parent_id IN {_IN} ORDER BY position, id LIMIT 100")
def direct_children(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.children(law(spark, sf), ANCHORS).select("id", "parent_id", "text")


@query(f"""WITH RECURSIVE {LAW}, down AS (SELECT id, position, 1 AS d FROM law WHERE parent_id IN {_IN} UNION ALL SELECT law.id, law.position, 2 FROM down JOIN law ON law.parent_id = down.id WHERE d = 1)
SELECT id, min(d) AS graph_distance FROM down GROUP BY id, position ORDER BY 2, position, id LIMIT 200""")
def hierarchy_below(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.below(law(spark, sf), ANCHORS).select("id", "graph_distance")


@query(f"WITH {LAW} SELECT id, text FROM law WHERE parent_id IN {_IN} AND regexp_matches(lower(text), 'trừ trường hợp|trừ |ngoại lệ|không được|chỉ được') ORDER BY position, id LIMIT 50")
def exception_records(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.exceptions(law(spark, sf), ANCHORS).select("id", "text")


@query(f"WITH {LAW} SELECT id, title, text FROM law WHERE id IN {_IN}")
def physical_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.physical(law(spark, sf), ANCHORS).select("id", "title", "text")


_NORM_EDGES = """e AS (SELECT id AS source, 'N' || (k % 50) AS target, 'MENTIONS' AS type FROM law WHERE k % 3 = 0
  UNION ALL SELECT DISTINCT 'N' || (k % 50), 'S' || (k % 7), 'HAS_SUBJECT' FROM law UNION ALL SELECT DISTINCT 'N' || (k % 50), 'T' || (k % 4), 'HAS_ACTION' FROM law WHERE k % 2 = 0)"""


def _norm_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, k = law(spark, sf), F.col("start_idx")
    norm = F.concat(F.lit("N"), (k % 50).cast("string"))
    edge = lambda s, t, kind: nodes.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("type"), k.alias("k"))
    told = edge(F.col("id"), norm, "MENTIONS").where("k % 3 = 0").drop("k")
    subject = edge(norm, F.concat(F.lit("S"), (k % 7).cast("string")), "HAS_SUBJECT").drop("k").distinct()
    action = edge(norm, F.concat(F.lit("T"), (k % 4).cast("string")), "HAS_ACTION").where("k % 2 = 0").drop("k").distinct()
    norms = nodes.select(norm.alias("id"), F.when(k % 2 == 0, "ALLOW").otherwise("REQUIRE").alias("modality")).distinct()
    return nodes, told.unionByName(subject).unionByName(action), norms


@query(f"""WITH RECURSIVE {LAW}, {_NORM_EDGES}, an AS (SELECT * FROM {_PLACES}), r AS (SELECT id AS anchor, place, id AS node, 0 AS d FROM an UNION ALL SELECT anchor, place, law.id, d + 1 FROM r JOIN law ON law.parent_id = r.node WHERE d < 3),
h AS (SELECT anchor, place, node, d, target AS norm_id, bool_or(d = 0) OVER (PARTITION BY anchor) AS own FROM r JOIN e ON e.source = r.node AND type = 'MENTIONS'),
s AS (SELECT source AS norm_id, string_agg(target, ',' ORDER BY target) FILTER (type = 'HAS_SUBJECT') AS subjects, string_agg(target, ',' ORDER BY target) FILTER (type = 'HAS_ACTION') AS actions FROM e WHERE type LIKE 'HAS%' GROUP BY 1)
SELECT anchor AS anchor_id, node AS source_id, norm_id, CASE WHEN substr(norm_id, 2)::INT % 2 = 0 THEN 'ALLOW' ELSE 'REQUIRE' END AS modality, coalesce(subjects, '') AS subjects, coalesce(actions, '') AS actions FROM h LEFT JOIN s USING (norm_id) WHERE d = 0 OR NOT own ORDER BY place, d, norm_id, node LIMIT 5000""")
def norm_traversal(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, norms = _norm_graph(spark, sf)
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return retrieve.norms_of(nodes, edges, norms, ANCHORS, limit=5000).select("anchor_id", "source_id", "norm_id", "modality", joined("subjects"), joined("actions"))


_TARGETS = """t AS (SELECT id, locator, k, text, CASE k % 5 WHEN 0 THEN ['LD2024:A' || (k % 15 + 1) || ':K2:Db'] WHEN 1 THEN ['LD2024:A' || (k % 15 + 1) || ':K1'] WHEN 3 THEN CASE WHEN k % 15 = 6 THEN ['LD2024:A7'] ELSE ['LD2024:A' || (k % 15 + 1), 'LD2024:A7'] END ELSE [] END AS found FROM law),
f AS (SELECT id, locator, k, text, list_filter(found, lambda x: x <> locator) AS found FROM t),
r AS (SELECT id AS source_id, locator AS source_locator, text AS source_text, unnest(found) AS target_locator, unnest(range(len(found))) AS place, k % 5 AS kind FROM f),
ref AS (SELECT r.* EXCLUDE (kind), CASE WHEN regexp_extract(target_locator, ':A(\\d+)', 1)::INT NOT BETWEEN 5 AND 12 THEN 'EXTERNAL_REFERENCE' WHEN kind = 1 THEN 'EXCEPTION_REFERENCE' WHEN kind = 3 THEN 'INHERITS_RIGHTS_OBLIGATIONS' ELSE 'DIRECT_REFERENCE' END AS relation_type,
  coalesce(law.id, 'external:' || target_locator) AS target_id, coalesce(law.text, '') AS target_text FROM r LEFT JOIN law ON law.locator = target_locator)"""


def _references(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.reference_edges(law(spark, sf), articles=(5, 12))


@query(f"WITH {LAW}, {_TARGETS} SELECT source_id, source_locator, place, target_locator, relation_type, target_id, target_text FROM ref")
def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf).select("source_id", "source_locator", F.col("place").cast("long").alias("place"), "target_locator", "relation_type", "target_id", "target_text")


@query(f"""WITH {LAW}, {_TARGETS}, an AS (SELECT * FROM {_PLACES}),
f1 AS (SELECT id, min(o) AS o FROM (SELECT id, place * 1000 AS o FROM an UNION ALL SELECT law.id, place * 1000 + position FROM an JOIN law ON law.parent_id = an.id) GROUP BY id),
s1 AS (SELECT ref.*, o, 1 AS hop FROM ref JOIN f1 ON f1.id = source_id),
g AS (SELECT target_id AS id, min(o) AS o FROM s1 WHERE target_id NOT LIKE 'external:%' GROUP BY 1),
f2 AS (SELECT id, min(o) AS o FROM (SELECT id, o * 1000 AS o FROM g UNION ALL SELECT law.id, g.o * 1000 + position FROM g JOIN law ON law.parent_id = g.id) GROUP BY id),
s2 AS (SELECT ref.*, o, 2 AS hop FROM ref JOIN f2 ON f2.id = source_id),
u AS (SELECT *, row_number() OVER (PARTITION BY source_locator, relation_type, target_locator ORDER BY hop, o, place) AS n FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2))
SELECT hop, source_locator, relation_type, target_locator FROM u WHERE n = 1""")
def reference_walk(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve.typed_paths(law(spark, sf), _references(spark, sf), ANCHORS, 2, 1_000_000)
    return found.select("hop", "source_locator", "relation_type", "target_locator")


@query(f"""WITH RECURSIVE {LAW}, {_TARGETS}, i AS (SELECT locator FROM law WHERE k % 4 < 3), e AS (SELECT DISTINCT source_locator AS a, target_locator AS b FROM ref WHERE source_locator IN (FROM i) AND target_locator IN (FROM i)),
w AS (SELECT a AS start, [a, b] AS places, b AS at, 1 AS n FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT start, list_append(places, e.b), e.b, n + 1 FROM w JOIN e ON e.a = w.at WHERE n < 5 AND NOT list_contains(places, e.b))
SELECT start, array_to_string(places, '>') AS places, n FROM w WHERE n = 5 OR NOT EXISTS (SELECT 1 FROM e WHERE e.a = w.at AND NOT list_contains(w.places, e.b))""")
def reference_paths(spark: SparkSession, sf: str) -> DataFrame:
    some = law(spark, sf).where("start_idx % 4 < 3").select(T.locator_of("id").alias("locator"))
    return retrieve.rebuilt_paths(_references(spark, sf), some).select("start", F.array_join("places", ">").alias("places"), "n")


@query(f"""WITH {LAW}, own AS (SELECT k, id, 'law_dieu-' || (k // 100) AS article, CASE WHEN k // 10 % 10 > 0 THEN 'law_dieu-' || (k // 100) || '_khoan-' || (k // 10 % 10) END AS clause FROM law),
w AS (SELECT k, id AS ref_id, CASE k % 6
  WHEN 0 THEN list_filter([(SELECT l.id FROM law l WHERE l.id = 'law_dieu-' || (own.k % 15 + 1)), (SELECT l.id FROM law l WHERE l.id = 'law_dieu-7' AND own.k % 15 <> 6)], lambda x: x IS NOT NULL)
  WHEN 1 THEN list_filter([(SELECT l.id FROM law l WHERE l.id = 'law_dieu-' || (own.k % 15 + 1) || '_khoan-2')], lambda x: x IS NOT NULL)
  WHEN 2 THEN [] WHEN 3 THEN list_filter([clause], lambda x: x IS NOT NULL)
  WHEN 4 THEN list_filter([(SELECT l.id FROM law l WHERE l.id = own.article || '_khoan-1')], lambda x: x IS NOT NULL) ELSE [] END AS targets FROM own)
SELECT ref_id, array_to_string(targets, ',') AS targets, CASE WHEN len(targets) > 0 THEN 'RESOLVED' WHEN k % 6 = 5 THEN 'OUT_OF_SCOPE' ELSE 'TARGET_NOT_FOUND' END AS status FROM w""")
def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """Two articles; a compound; a foreign statute; the own clause; a clause of the own article; an external reference."""
    nodes, k = law(spark, sf), F.col("start_idx")
    article = (k % 15 + 1).cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Điều "), article, F.lit(" và Điều 7"))).when(k % 6 == 1, F.concat(F.lit("khoản 2 Điều "), article)).when(k % 6 == 2, F.concat(F.lit("theo Điều "), article, F.lit(" Luật Đầu tư")))
        .when(k % 6 == 3, "khoản này").when(k % 6 == 4, "khoản 1 Điều này").otherwise("Điều 7")
    )
    refs = nodes.select(F.col("id").alias("ref_id"), F.col("id").alias("source_node_id"), text.alias("text"), F.when(k % 6 == 5, "EXTERNAL").alias("scope"))
    number = F.when(F.col("type") == "ARTICLE", F.col("number")).when(F.col("type") == "CLAUSE", F.floor(k / 10) % 10)
    places = nodes.select("id", "parent_id", F.col("type").alias("label"), number.cast("string").alias("number"), F.lit("31/2024/qh15").alias("law_code"))
    titles = spark.createDataFrame([("31/2024/qh15", ["dat", "dai"])], "law_code string, title_tokens array<string>")
    return references.resolve(refs, places, titles).select("ref_id", F.array_join("targets", ",").alias("targets"), "status")


# --- questions, scores, contexts --------------------------------------------------------------------------------------
_ASKED = "asked AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'liệt kê các điều kiện cho thuê' WHEN 1 THEN 'trừ trường hợp nào' WHEN 2 THEN 'ai được đăng ký' WHEN 3 THEN 'ngoại lệ tại ngân hàng, bao gồm những gì' WHEN 4 THEN 'so sánh' ELSE text END AS q FROM benchmark)"


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id") % 6
    q = F.when(i == 0, "liệt kê các điều kiện cho thuê").when(i == 1, "trừ trường hợp nào").when(i == 2, "ai được đăng ký").when(i == 3, "ngoại lệ tại ngân hàng, bao gồm những gì").when(i == 4, "so sánh").otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", q.alias("q"))


_FACETS = {"CONDITION": "dieu kien|dap ung|khi co du|phai", "EXCEPTION": "ngoai le|tru truong hop|khong ap dung|chi duoc", "LIST": "bao gom|liet ke|nhung gi|cac dieu kien", "RECIPIENT": "tai ai|cho ai|ben nhan|to chuc tin dung|ngan hang", "SUBJECT": "ai|chu the|doi tuong|to chuc|ca nhan|nguoi"}


@query(f"WITH {_ASKED}, f AS (SELECT item_id, replace(replace(lower(strip_accents(q)), 'đ', 'd'), 'ß', 'ss') AS t FROM asked) SELECT item_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in _FACETS.items()) + "], lambda x: x IS NOT NULL), ',') AS facets FROM f")
def question_facets(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("item_id", F.array_join(retrieve.facets_of("q"), ",").alias("facets"))


_SIGNALS = {"LIST_REQUEST": "các điều kiện|bao gồm những gì|nội dung chính|các trường hợp|những quyền|nghĩa vụ nào|liệt kê", "REFERENCE_REQUEST": "theo điều|quy định tại|ngoài điều kiện|quyền và nghĩa vụ tương ứng|dẫn chiếu", "EXCEPTION_REQUEST": "trừ trường hợp|ngoại lệ|không được|chỉ được|bị cấm|hạn chế", "SUBJECT_REQUEST": "(^|[^\\pL\\pN_])ai([^\\pL\\pN_]|$)|đối tượng nào|tổ chức nào|cá nhân nào|chủ thể|có được phép", "COMPARISON_REQUEST": "so sánh|khác nhau|phân biệt|tương ứng", "MULTI_HOP_REQUEST": "đồng thời|và các điều kiện|quyền và nghĩa vụ chung|theo các điều"}
_RULED = {"requires_all_children": ["LIST_REQUEST"], "requires_reference_traversal": ["REFERENCE_REQUEST", "MULTI_HOP_REQUEST"], "requires_exception": ["EXCEPTION_REQUEST"], "requires_subject_resolution": ["SUBJECT_REQUEST"], "requires_parent_context": ["SUBJECT_REQUEST"], "requires_multi_hop": ["MULTI_HOP_REQUEST"], "requires_comparison": ["COMPARISON_REQUEST"]}
_CAUTIOUS = ["requires_parent_context", "requires_reference_traversal", "requires_subject_resolution"]
_HAS = {f: "(" + " OR ".join(f"list_contains(s, '{x}')" for x in xs) + ")" for f, xs in _RULED.items()}
_ROUTED = f"""{_ASKED}, sg AS (SELECT item_id, q, list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(q), '{p}') THEN '{n}' END" for n, p in _SIGNALS.items())}], lambda x: x IS NOT NULL) AS s FROM asked)"""


@query(f"WITH {_ROUTED} SELECT item_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {h} THEN ' + repr(f) + ' END' for f, h in _HAS.items())}], lambda x: x IS NOT NULL), ',') AS features FROM sg")
def question_features(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf).withColumn("f", retrieve.features_of(retrieve.signals_of("q")))
    return q.select("item_id", F.array_join(F.filter(F.array(*map(F.lit, retrieve.FEATURES)), lambda x: F.array_contains(F.col("f"), x)), ",").alias("features"))


_P = {"requires_exception": "(item_id % 10) / 10.0", "requires_reference_traversal": "(item_id % 7) / 10.0"}


def _on(feature: str) -> str:
    least = 0.35 if feature == "requires_reference_traversal" else 0.40
    by_answer = f"(item_id % 3 > 0 AND {_P[feature]} >= {least})" if feature in _P else "false"
    return f"CASE WHEN {_HAS[feature]} OR {by_answer}{' OR item_id % 3 = 0' if feature in _CAUTIOUS else ''} THEN '{feature}' END"


@query(f"""WITH {_ROUTED} SELECT item_id, array_to_string(s, ',') AS signals, array_to_string(list_filter([{", ".join(_on(f) for f in _RULED)}], lambda x: x IS NOT NULL), ',') AS activated,
array_to_string(list_filter([{", ".join(f"CASE WHEN item_id % 3 > 0 AND {p} >= 0.40 AND {p} < 0.60 THEN '{f}' END" for f, p in sorted(_P.items(), key=lambda x: list(_RULED).index(x[0])))}], lambda x: x IS NOT NULL), ',') AS uncertain, CASE WHEN item_id % 3 = 0 THEN 'RULES_AND_FALLBACK' ELSE 'RULES_AND_SERVICE' END AS routing_source FROM sg""")
def question_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Every third question gets no answer of the service."""
    i = F.col("item_id")
    answer = F.when(i % 3 > 0, F.create_map(F.lit("requires_exception"), (i % 10) / 10.0, F.lit("requires_reference_traversal"), (i % 7) / 10.0))
    r = retrieve.route_questions(_questions(spark, sf), "q", answer)
    return r.select("item_id", *[F.array_join(c, ",").alias(c) for c in ("signals", "activated", "uncertain")], "routing_source")


_QUESTION = "điều kiện đăng ký"
_SCORED = """x AS (SELECT *, list_filter(list_distinct(regexp_extract_all(replace(lower(strip_accents(text)), 'đ', 'd'), '[a-z0-9]+')), lambda t: length(t) > 2) AS ts, replace(lower(strip_accents(text)), 'đ', 'd') AS said FROM law),
sc AS (SELECT *, len(list_filter(ts, lambda t: t IN ('dieu', 'kien', 'dang'))) / 3.0 AS ov FROM x)"""


@query(f"""WITH {LAW}, {_SCORED}, z AS (SELECT id, parent_id, position, round(CASE WHEN contains(said, 'dang ky') THEN 0.40 ELSE 0 END + 0.25 * ov + CASE WHEN regexp_matches(said, 'dieu kien|phai|da |co ') THEN 0.15 ELSE 0 END + 0.10, 6)::DOUBLE AS score,
regexp_replace(locator, ':[^:]*$', '') AS up FROM sc WHERE k % 100 > 0), y AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY score DESC, position, id) AS n FROM z WHERE up IN ('LD2024:A1', 'LD2024:A2', 'LD2024:A2:K3', 'LD2024:A12:K4')) SELECT id AS node_id, up AS parent_locator, score FROM y WHERE n = 1 OR (n <= 5 AND score >= 0.25)""")
def selected_children(spark: SparkSession, sf: str) -> DataFrame:
    rows = law(spark, sf).where("parent_id is not null").withColumnsRenamed({"id": "node_id"}).withColumn("parent_locator", T.locator_of("parent_id"))
    return retrieve.select_children(_QUESTION, rows, ["LD2024:A1", "LD2024:A2", "LD2024:A2:K3", "LD2024:A12:K4"]).select("node_id", "parent_locator", "score")


@query("WITH r AS (SELECT n_name AS node_id, n_nationkey / 25.0 AS rank_score, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey / 30.0 END AS rel FROM nation), g AS (SELECT *, coalesce(rel, 0.0) AS relevance, bool_or(coalesce(rel, 0.0) >= 0.45) OVER () AS any_ FROM r) SELECT node_id, round(relevance, 6)::DOUBLE AS relevance FROM g WHERE any_ AND relevance >= 0.45")
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as the candidates of one question; those without an answer count as irrelevant."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("node_id"), (F.col("n_nationkey") / 25.0).alias("rank_score"), (F.col("n_nationkey") / 30.0).alias("relevance"), "n_nationkey")
    kept, _, _ = retrieve.assess(n.select("node_id", "rank_score"), lambda q, r: (n.where("n_nationkey % 4 > 0").select("node_id", "relevance"), {}))
    return kept.select("node_id", F.round("relevance", 6).alias("relevance"))


@query(f"""WITH {LAW}, {_TARGETS}, c AS (SELECT id AS node_id, locator AS canonical_locator, text, 'ANCHOR' AS source_type, 0 AS graph_distance, NULL AS relation_type FROM law WHERE k % 7 = 0
UNION ALL SELECT id, locator, text, 'CHILD', 1, NULL FROM law WHERE k % 7 = 1 UNION ALL SELECT source_id, source_locator, source_text, 'REFERENCE_SOURCE', 1, relation_type FROM ref UNION ALL SELECT target_id, target_locator, target_text, 'REFERENCE_TARGET', 1, relation_type FROM ref)
SELECT node_id, canonical_locator, text, source_type, graph_distance, relation_type FROM c WHERE trim(text) <> ''""")
def collected_candidates(spark: SparkSession, sf: str) -> DataFrame:
    nodes = law(spark, sf)
    sources = {"ANCHOR": nodes.where("start_idx % 7 = 0").withColumnRenamed("id", "node_id"), "CHILD": nodes.where("start_idx % 7 = 1").withColumnRenamed("id", "node_id").withColumn("graph_distance", F.lit(1))}
    found = retrieve.collect(sources, _references(spark, sf).withColumn("hop", F.lit(1)))
    return found.select("node_id", "canonical_locator", "text", "source_type", "graph_distance", "relation_type")


_SAID = "CASE WHEN type = 'POINT' THEN 'điểm ' || substr('abcdeghik', (k % 10)::INT, 1) || ' ' ELSE '' END || CASE WHEN k // 10 % 10 > 0 THEN 'khoản ' || (k // 10 % 10) || ' ' ELSE '' END || 'Điều ' || (k // 100)"


@query(f"""WITH {LAW} SELECT id, CASE WHEN k // 10 % 10 = 0 AND k % 10 > 0 THEN 'x' ELSE '[' || locator || ']' || chr(10) || 'Căn cứ: ' || {_SAID} || chr(10) || 'Loại evidence: CHILD, ' || type || chr(10) || 'Nguồn truy hồi: CHILD' || CASE WHEN k % 2 = 0 THEN chr(10) || 'Dẫn chiếu: ' || locator || ' --DIRECT_REFERENCE--> UNRESOLVED' ELSE '' END || chr(10) || 'Nguyên văn: ' || text END AS section FROM law""")
def rendered_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Points without a clause have no locator in words, and are left to the tests."""
    n = law(spark, sf).withColumn("canonical_locator", T.locator_of("id"))
    even, none = F.col("start_idx") % 2 == 0, F.lit(None).cast("string")
    n = n.withColumns({"roles": F.array(F.lit("CHILD"), "type"), "source_type": F.lit("CHILD"), "relation_type": F.when(even, "DIRECT_REFERENCE"), "source_locator": F.col("canonical_locator"), "target_locator": none})
    bare = (F.floor(F.col("start_idx") / 10) % 10 == 0) & (F.col("start_idx") % 10 > 0)
    return n.select("id", F.when(bare, "x").otherwise(retrieve.rendered(n)).alias("section"))


@query(f"""WITH {LAW} SELECT id, CASE WHEN k % 2 = 0 THEN '31/2024/QH15, ' ELSE '' END || CASE type WHEN 'ARTICLE' THEN 'Điều ' || number || ', ' WHEN 'CLAUSE' THEN CASE WHEN k % 3 = 0 THEN 'Điều ' || (k // 100) || ', ' ELSE '' END || 'khoản ' || number || ', ' ELSE CASE WHEN k % 3 = 0 THEN 'Điều ' || (k // 100) || ', ' ELSE '' END || 'điểm ' || number || ', ' END || 'node ' || id AS citation FROM law""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("start_idx")
    n = law(spark, sf).withColumns({"law_code": F.when(k % 2 == 0, "31/2024/QH15"), "labels": F.array("type"), "article_number": F.when((k % 3 == 0) & (F.col("type") != "ARTICLE"), F.floor(k / 100)), "node_id": F.col("id")})
    return n.select("id", retrieve.citation().alias("citation"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(text, 1, 200 - length(chr(10) || '[Ngữ cảnh đã được giới hạn.]'))) || chr(10) || '[Ngữ cảnh đã được giới hạn.]' END AS text FROM documents")
def bounded_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", retrieve.bounded(F.col("text"), 200).alias("text"))


@query(f"WITH {LAW}, s AS (SELECT id, parent_id FROM law WHERE k % 3 > 0) SELECT DISTINCT a.parent_id, a.id FROM s a JOIN s b ON b.id = a.parent_id")
def hierarchy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = law(spark, sf)
    return retrieve.hierarchy_context(n, n.where("start_idx % 3 > 0").withColumnRenamed("id", "node_id")).select("parent_id", "id")


@query("""WITH n AS (SELECT l_suppkey AS s, list_sort(list_distinct(list(l_returnflag))) AS f, list_sort(list_distinct(list(l_linestatus))) AS t, min(l_partkey) AS p FROM lineitem GROUP BY 1),
x AS (SELECT p, s, 'Quy tắc (' || s || '): ' || CASE s % 3 WHEN 0 THEN 'được phép' WHEN 1 THEN 'bị cấm' ELSE 'OTHER' END || chr(10) || 'Chủ thể: ' || CASE WHEN s % 4 = 0 THEN 'không xác định' ELSE array_to_string(f, ', ') END || chr(10) || 'Hành động: ' || array_to_string(t, ', ') || CASE WHEN s % 2 = 0 THEN chr(10) || 'Điều kiện: ' || array_to_string(f, ', ') ELSE '' END || chr(10) || 'Nguyên văn: e' || s || chr(10) || 'Căn cứ: c1; c2' AS sec FROM n)
SELECT string_agg(sec, chr(10) || chr(10) ORDER BY p, s::VARCHAR) AS context FROM x""")
def norm_context(spark: SparkSession, sf: str) -> DataFrame:
    s, none = F.col("l_suppkey"), F.array().cast("array<string>")
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"), F.sort_array(F.collect_set("l_linestatus")).alias("t"), F.min("l_partkey").alias("place"))
    rows = n.select(
        s.cast("string").alias("norm_id"), F.when(s % 3 == 0, "ALLOW").when(s % 3 == 1, "PROHIBIT").otherwise("OTHER").alias("modality"), F.when(s % 4 == 0, none).otherwise(F.col("f")).alias("subjects"), F.col("t").alias("actions"), none.alias("objects"),
        F.when(s % 2 == 0, F.col("f")).otherwise(none).alias("conditions"), none.alias("exceptions"), none.alias("consequences"), F.concat(F.lit("e"), s.cast("string")).alias("evidence"), F.explode(F.array(F.lit("c2"), F.lit("c1"))).alias("citation"), "place",
    )
    return retrieve.assemble_norms(rows, None)


@query(f"WITH {LAW}, n AS (SELECT id, coalesce(nullif(trim(text), ''), title) AS said FROM law WHERE id IN {_IN} OR parent_id IN {_IN}) SELECT string_agg('Đoạn nguồn: ' || said || chr(10) || 'Căn cứ: node ' || id, chr(10) || chr(10) ORDER BY id) AS context FROM n")
def path_context(spark: SparkSession, sf: str) -> DataFrame:
    n = law(spark, sf)
    paths = n.where(F.col("parent_id").isin(ANCHORS)).select(F.array("parent_id", "id").alias("nodes")).unionByName(n.where(F.col("id").isin(ANCHORS)).select(F.array("id").alias("nodes")))
    return retrieve.assemble_paths(paths, n, 1_000_000)


@query("SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'SUBJECT' END, CASE WHEN o_orderkey % 3 = 0 THEN 'ACTION' END, CASE WHEN o_orderkey % 5 = 0 THEN 'CONDITION' END, CASE WHEN o_orderkey % 2 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN 'NORM' END], lambda x: x IS NOT NULL), ',') AS roles FROM orders")
def roles_of_norms(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    has = lambda n: F.when(k % n == 0, F.array(F.lit("x"))).otherwise(none)
    o = table(spark, sf, "orders").select(k.alias("id"), has(2).alias("subjects"), has(3).alias("actions"), has(5).alias("conditions"))
    return o.select("id", F.array_join(retrieve.norm_roles(o), ",").alias("roles"))


# --- graph rows -------------------------------------------------------------------------------------------------------
@query(f"""WITH {LAW}, s AS (SELECT id, lead(id) OVER (PARTITION BY parent_id, type ORDER BY start_idx, id) AS nx FROM law WHERE parent_id IS NOT NULL)
SELECT id AS source, parent_id AS target, 'BELONG_TO' AS type FROM law WHERE parent_id IS NOT NULL UNION ALL SELECT id, nx, 'NEXT' FROM s WHERE nx IS NOT NULL UNION ALL SELECT nx, id, 'PREVIOUS' FROM s WHERE nx IS NOT NULL""")
def physical_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(law(spark, sf))


@query(f"WITH {LAW} SELECT id, 'PHYSICAL' AS node_kind, 'LegalNode,' || type AS labels, coalesce('parent_id=' || parent_id || ';', '') || 'position=' || position || ';text=' || text || ';title=' || title AS properties, 'M4' AS provenance FROM law")
def physical_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = graph.graph_nodes(law(spark, sf).drop("start_idx", "number"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return n.select("id", "node_kind", F.array_join("labels", ",").alias("labels"), pairs.alias("properties"), F.array_join("provenance", ",").alias("provenance"))


@query("SELECT p_partkey AS id, 'SEMANTIC' AS node_kind, CASE WHEN p_size % 3 = 0 THEN 'SemanticEntity,Reference,' ELSE 'SemanticEntity,' END || p_type AS labels, 'M7' AS provenance FROM part")
def semantic_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("ontology_class"), F.when(F.col("p_size") % 3 == 0, "REFERENCE").otherwise("MENTION").alias("fusion_kind"), F.create_map(F.lit("brand"), "p_brand").alias("properties"))
    return graph.semantic_nodes(e).select("id", "node_kind", F.array_join("labels", ",").alias("labels"), F.array_join("provenance", ",").alias("provenance"))


@query("SELECT l_partkey AS source, l_suppkey AS target, 'HAS_OBJECT' AS type, l_linenumber AS weight, round(least(1, greatest(0, (CASE WHEN l_linenumber = 1 THEN 0.5 ELSE 1 - (1 - l_discount) * (1 - l_tax) END) * 0.8)), 4)::DOUBLE AS confidence FROM lineitem")
def semantic_edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("double")
    signals = F.when(F.col("l_linenumber") == 1, F.array(none, none)).otherwise(F.array("l_discount", "l_tax"))
    r = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("HAS_OBJECT").alias("relation_type"), F.array_repeat(F.lit("n"), F.col("l_linenumber")).alias("source_node_ids"), signals.alias("signals"), F.lit(0.8).alias("source_weight"))
    return graph.semantic_edges(r).drop("provenance")


@query("SELECT DISTINCT o_custkey AS source, t AS target, 'RESOLVES_TO' AS type FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS t FROM orders)")
def resolves_to_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.resolves_to(table(spark, sf, "orders").select(F.col("o_custkey").alias("reference_id"), F.array("o_orderstatus", "o_orderpriority").alias("target_ids")))


@query(f"""WITH {LAW} SELECT id, id || ' PHYSICAL LegalNode ' || type || ' {{' || CASE WHEN parent_id IS NULL THEN '' ELSE '"parent_id":"' || parent_id || '",' END || '"text":"' || text || '","title":"' || title || '"}}' AS search_text FROM law""")
def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.search_text(graph.graph_nodes(law(spark, sf).drop("start_idx", "number", "position"))).select("id", "search_text")


@query("SELECT vec_id AS id, label, len(embedding) AS length FROM embeddings")
def embedded_nodes(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    both = graph.attach_embeddings(v.select(F.col("vec_id").alias("id"), "label"), v.select(F.col("vec_id").alias("node_id"), "embedding"))
    return both.select("id", "label", F.size("embedding").cast("long").alias("length"))


@query(f"WITH {LAW}, s AS (SELECT parent_id, type, count(*) AS n FROM law WHERE parent_id IS NOT NULL GROUP BY 1, 2) SELECT '1.0' AS schema_version, 'part' AS document_id, (SELECT count(*) FROM law) AS total_nodes, (SELECT sum(n + 2 * (n - 1))::BIGINT FROM s) AS total_edges")
def graph_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build(law(spark, sf), "part")[2]


# --- validation -------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey::VARCHAR AS node_id, 'VAL-000' AS rule_id FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def schema_errors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 11 > 0, F.col("o_orderstatus")).alias("type"), F.when(k % 13 == 0, "x1").otherwise(k.cast("string")).alias("position"))
    return validate.bad_schema(n).select("node_id", "rule_id")


@query("SELECT node_id::VARCHAR AS node_id, 'VAL-001' AS rule_id, 'ERROR' AS severity, 'id occurs again: ' || node_id AS message FROM (SELECT o_custkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1")
def repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("start_idx"))
    return validate.duplicate_ids(o).select("node_id", "rule_id", "severity", "message")


_FAULTY = f"""{LAW}, bad AS (SELECT k, id, CASE WHEN k % 100 = 0 THEN 'CHAPTER' ELSE type END AS type, CASE WHEN k % 83 = 0 THEN NULL WHEN k % 89 = 0 THEN 'nowhere' ELSE parent_id END AS parent_id, CASE WHEN k % 97 = 0 THEN ' ' ELSE text END AS text FROM law)"""


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("start_idx"), law(spark, sf)
    return n.withColumns({"type": F.when(k % 100 == 0, "CHAPTER").otherwise(F.col("type")), "parent_id": F.when(k % 83 == 0, F.lit(None)).when(k % 89 == 0, "nowhere").otherwise(F.col("parent_id")), "text": F.when(k % 97 == 0, " ").otherwise(F.col("text"))})


_ISSUES = """i AS (SELECT id AS node_id, 'VAL-002' AS rule_id, 'ERROR' AS severity FROM bad WHERE parent_id IS NULL AND type NOT IN ('PART', 'CHAPTER', 'TEXT') UNION ALL SELECT id, 'VAL-003', 'ERROR' FROM bad WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM bad)
UNION ALL SELECT id, 'VAL-005', 'WARNING' FROM bad WHERE type IN ('CLAUSE', 'POINT') AND trim(text) = '')"""


@query(f"WITH {_FAULTY}, {_ISSUES} SELECT * FROM i")
def integrity_suite(spark: SparkSession, sf: str) -> DataFrame:
    return validate.integrity(_faulty(spark, sf)).select("node_id", "rule_id", "severity")


@query(f"""WITH RECURSIVE {_FAULTY}, {_ISSUES}, gone AS (SELECT node_id AS id FROM i WHERE severity = 'ERROR' UNION SELECT bad.id FROM gone JOIN bad ON bad.parent_id = gone.id), t AS (SELECT count(*) AS n, count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity <> 'ERROR') AS w FROM (SELECT severity FROM i UNION ALL SELECT 'ERROR' FROM gone WHERE id NOT IN (SELECT node_id FROM i WHERE severity = 'ERROR')))
SELECT (SELECT count(*) FROM bad) AS received, (SELECT count(*) FROM bad WHERE id NOT IN (SELECT id FROM gone)) AS kept, e AS errors, w AS warnings FROM t""")
def validated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = _faulty(spark, sf).withColumns({"marker": F.lit(None).cast("string"), "number": F.lit(None).cast("string")})
    kept, _, report = validate.validate(n)
    return report.select(F.col("total_nodes_received").alias("received"), F.lit(kept.count()).cast("long").alias("kept"), F.col("fatal_errors_count").alias("errors"), F.col("warnings_count").alias("warnings"))


@query("""WITH s AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'CHAPTER' ELSE 'POINT' END AS type, l_linenumber + l_orderkey % 9 AS v FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT l_orderkey, type, min(v) AS lo, max(v) AS hi FROM s GROUP BY 1, 2),
m AS (SELECT l_orderkey, type, unnest(range(lo, hi + 1)) AS v FROM g) SELECT l_orderkey AS parent, CASE WHEN type = 'CHAPTER' THEN 'chapter_' || ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII'][v] ELSE 'point_' || ['a','b','c','d','đ','e','g','h','i','k','l','m','n','o','p','q','r','s'][v] END AS node_id FROM m ANTI JOIN s USING (l_orderkey, type, v)""")
def marker_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Roman chapters and letters of points, made of line numbers."""
    v, chapter = F.col("v"), F.col("l_orderkey") % 2 == 0
    s = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") + F.col("l_orderkey") % 9).cast("int").alias("v")).distinct()
    of = lambda names: F.get(F.array(*map(F.lit, names)), v - 1)
    n = s.select(F.col("l_orderkey").alias("parent_id"), F.when(chapter, "CHAPTER").otherwise("POINT").alias("type"), F.when(chapter, of(validate.ROMAN[:18])).alias("number"), F.when(~chapter, F.upper(of(validate.LETTERS[:18]))).alias("marker"), F.lit(None).cast("string").alias("title"), v.alias("start_idx"))
    return validate.sequence_gaps(n).select(F.regexp_extract("message", r"under (\d+)", 1).cast("long").alias("parent"), "node_id")


_MULTI = """nodes AS (SELECT CASE WHEN c_custkey % 50 = 7 THEN ' ' ELSE 'c' || (c_custkey - CASE WHEN c_custkey % 40 = 1 THEN 1 ELSE 0 END) END AS id, c_custkey % 30 = 0 AS bare FROM customer),
edges AS (SELECT 'c' || o_custkey AS source, 'c' || (o_orderkey % 1500) AS target, CASE WHEN o_orderkey % 500 = 0 THEN 'has_lower' ELSE 'HAS' END AS type, o_orderkey // 2 AS edge_key FROM orders)"""


def _multigraph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    name = F.when(c % 50 == 7, " ").otherwise(F.concat(F.lit("c"), (c - F.when(c % 40 == 1, 1).otherwise(0)).cast("string")))
    nodes = table(spark, sf, "customer").select(name.alias("id"), F.when(c % 30 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("L"))).alias("labels"))
    edges = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("c"), (k % 1500).cast("string")).alias("target"), F.when(k % 500 == 0, "has_lower").otherwise("HAS").alias("type"), F.floor(k / 2).alias("edge_key"))
    return nodes, edges


@query(f"""WITH {_MULTI} SELECT 'EMPTY_ID' AS rule, id AS key FROM nodes WHERE trim(id) = '' UNION ALL SELECT 'DUPLICATE_ID', id FROM nodes GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'NO_LABELS', id FROM nodes WHERE bare UNION ALL SELECT 'EDGE_TYPE', type FROM edges WHERE type = 'has_lower'
UNION ALL SELECT 'DUPLICATE_EDGE', edge_key::VARCHAR FROM edges GROUP BY edge_key HAVING count(*) > 1 UNION ALL SELECT 'MISSING_END', source || '>' || target FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)""")
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    return validate.graph_contract(*_multigraph(spark, sf))


@query(f"WITH {_MULTI}, f AS (SELECT source, target, list_filter([CASE WHEN source NOT IN (SELECT id FROM nodes) THEN source END, CASE WHEN target NOT IN (SELECT id FROM nodes) THEN target END], lambda x: x IS NOT NULL) AS m FROM edges) SELECT source, target, array_to_string(m, ',') AS missing FROM f WHERE len(m) > 0")
def missing_ends(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _multigraph(spark, sf)
    return validate.orphan_edges(edges, nodes).select("source", "target", F.array_join("missing_nodes", ",").alias("missing"))


@query(f"WITH {_MULTI} SELECT 1500 AS expected_nodes, (SELECT count(*) FROM nodes) AS nodes, 15000 AS expected_edges, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)) AS orphans, (SELECT count(*) FROM nodes) = 1500 AND (SELECT count(*) FROM edges) = 15000 AS valid")
def count_audit(spark: SparkSession, sf: str) -> DataFrame:
    return validate.audit(1500, 15000, *_multigraph(spark, sf))


_KINDS = "n AS (SELECT p_partkey AS id, ['LEGAL_SUBJECT', 'LEGAL_ACTION', 'CONDITION', 'EXCEPTION', 'ARTICLE'][(p_partkey % 5 + 1)::INT] AS kind, p_size - 5 AS number FROM part), e AS (SELECT l_partkey AS source, (l_partkey + l_suppkey) % 2500 AS target, ['ALLOW', 'HAS_CONDITION', 'HAS_EXCEPTION', 'IS_A', 'NEXT', 'OTHER'][(l_linenumber - 1) % 6 + 1] AS type FROM lineitem)"
_PAIRS = "('ALLOW', 'LEGAL_SUBJECT', 'LEGAL_ACTION'), ('HAS_CONDITION', 'LEGAL_SUBJECT', 'CONDITION'), ('HAS_CONDITION', 'LEGAL_ACTION', 'CONDITION'), ('HAS_EXCEPTION', 'LEGAL_ACTION', 'EXCEPTION'), ('HAS_EXCEPTION', 'CONDITION', 'EXCEPTION'), ('IS_A', 'LEGAL_SUBJECT', 'LEGAL_SUBJECT'), ('IS_A', 'LEGAL_ACTION', 'LEGAL_ACTION'), ('IS_A', 'CONDITION', 'CONDITION'), ('IS_A', 'EXCEPTION', 'EXCEPTION')"


@query(f"""WITH {_KINDS}, t AS (SELECT e.*, a.kind AS a, b.kind AS b FROM e LEFT JOIN n a ON a.id = source LEFT JOIN n b ON b.id = target)
SELECT 'PAIR' AS rule, source, target FROM t WHERE type IN ('ALLOW', 'HAS_CONDITION', 'HAS_EXCEPTION', 'IS_A') AND NOT EXISTS (SELECT 1 FROM (VALUES {_PAIRS}) AS p(x, y, z) WHERE x = type AND y = a AND z = b) UNION ALL SELECT 'SEQUENCE_LEVEL', source, target FROM t WHERE type = 'NEXT' AND a IS DISTINCT FROM b
UNION ALL SELECT 'MISSING_END', source, target FROM t WHERE a IS NULL OR b IS NULL UNION ALL SELECT 'ARTICLE_NUMBER', id, NULL FROM n WHERE kind = 'ARTICLE' AND number <= 0""")
def shape_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    nodes = table(spark, sf, "part").select(k.alias("id"), F.get(F.array(*map(F.lit, ["LEGAL_SUBJECT", "LEGAL_ACTION", "CONDITION", "EXCEPTION", "ARTICLE"])), (k % 5).cast("int")).alias("kind"), (F.col("p_size") - 5).cast("string").alias("number"))
    kind = F.get(F.array(*map(F.lit, ["ALLOW", "HAS_CONDITION", "HAS_EXCEPTION", "IS_A", "NEXT", "OTHER"])), (F.col("l_linenumber") - 1) % 6)
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), ((F.col("l_partkey") + F.col("l_suppkey")) % 2500).alias("target"), kind.alias("type"))
    return validate.shapes(nodes, edges).select("rule", "source", F.col("target").cast("long").alias("target"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey * 3 NOT IN (SELECT l_partkey FROM lineitem)")
def ungrounded_norms(spark: SparkSession, sf: str) -> DataFrame:
    norms = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "VALID").otherwise("FLAGGED").alias("status"), (F.col("o_custkey") * 3).alias("provenance_node_id"))
    fused = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("source_node_ids"))
    return validate.ungrounded_norms(norms, fused).select("id")


@query("SELECT name, has_cycle FROM (VALUES ('tree', false), ('ring', true)) AS t(name, has_cycle)")
def cycle_test(spark: SparkSession, sf: str) -> DataFrame:
    """The statute's own edges, which are a forest, and the same with one edge back."""
    e = graph.belong_to(law(spark, sf)).select("source", "target")
    back = spark.createDataFrame([("law_dieu-1", "law_dieu-1_khoan-5_diem-a")], "source string, target string")
    return spark.createDataFrame([("tree", validate.has_cycle(e)), ("ring", validate.has_cycle(e.unionByName(back)))], "name string, has_cycle boolean")
