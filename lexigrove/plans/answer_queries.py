"""Registered queries of question profiles, the fit of texts, and paths of proof, for tables of questions.

The statute is that of `graph_queries` with a phrase of law added to each text, the questions are the benchmark's texts with a
question of law before them. The SQL is written from the formulas; only phrases and lists are taken from the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, retrieve
from ..session import staged, table
from .graph_queries import _TARGETS, LAW, law
from .queries import query

ASKED = [
    "Doanh nghiệp có vốn đầu tư nước ngoài muốn bán tài sản cần điều kiện gì?", "Tổ chức kinh tế được trả tiền thuê đất hằng năm có quyền chuyển nhượng tại ai?", "Cá nhân muốn cho thuê lại đất trong khu công nghiệp",
    "Xác định quyền bán tài sản đồng thời cùng quyền thuê trong hợp đồng thuê đất", "Trừ trường hợp nào không được thế chấp, góp vốn?", "Các điều kiện đăng ký", "Người sử dụng đất tặng cho; thừa kế", "quyền và nghĩa vụ chung",
]
SAID = [
    "Tổ chức kinh tế có vốn đầu tư nước ngoài được bán tài sản", "khi có đủ các điều kiện sau đây", "trả tiền thuê đất hằng năm trong khu công nghiệp", "đã đăng ký; có giấy chứng nhận", "cá nhân được chuyển nhượng, cho thuê lại đất",
    "quyền thuê trong hợp đồng thuê đất khi có đủ các điều kiện", "đơn vị sự nghiệp công lập, dự án đầu tư kết cấu hạ tầng", "tổ chức tôn giáo không được thế chấp", "điều kiện sau đây", "bán tài sản gắn liền với đất thuê", "nộp tiền hằng năm",
]


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))


def fold_sql(text: str) -> str:
    return f"replace(replace(lower(strip_accents({text})), 'đ', 'd'), 'ß', 'ss')"


def tokens_sql(folded: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({folded}, '[a-z0-9]+')), lambda t: length(t) > 2 AND NOT list_contains({_list(T.QUESTION_STOPWORDS)}, t))"


_ACTS = "[" + ", ".join("{'a': '" + retrieve.folded(a) + "', 't': " + _list(retrieve.question_tokens(a)) + "}" for a in retrieve.ACTIONS) + "]"
_DISTINCT = "[" + ", ".join("{'p': '" + retrieve.folded(p) + "', 't': " + _list(retrieve.question_tokens(p)) + "}" for p in answers.REGIMES) + "]"
_CONCEPTS = "[" + ", ".join("{'c': '" + c + "', 'p': " + _list([retrieve.folded(p) for p in ps]) + "}" for c, ps in answers.CONCEPTS.items()) + "]"
_FACETS = "[" + ", ".join("{'f': '" + f + "', 'p': " + _list([retrieve.folded(p) for p in ps]) + "}" for f, ps in retrieve.FACETS.items()) + "]"


def _acts_sql(tokens: str) -> str:
    return f"list_transform(list_filter({_ACTS}, lambda a: len(list_filter(a.t, lambda x: NOT list_contains({tokens}, x))) = 0), lambda a: a.a)"


def _has(folded: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({folded}, '{p}')" for p in phrases) + ")"


def _role(folded: str, role: str) -> str:
    return f"list_filter({_list([retrieve.folded(p) for p in answers.ROLES[role]])}, lambda p: contains({folded}, p))"


_TAILS = "".join(f", CASE WHEN regexp_matches(f, '\\b{c}\\b\\s') THEN {_acts_sql(tokens_sql(f'''regexp_extract(f, '\\b{c}\\b\\s+([^.!?;:]{{0,100}})', 1)'''))} ELSE [] END AS c{i}" for i, c in enumerate(answers.CUES))


def profile_sql(questions: str) -> str:
    """CTEs that make `qp` of a table (qid, question)."""
    return f"""q0 AS (SELECT *, {fold_sql("question")} AS f FROM {questions}), q1 AS (SELECT *, {tokens_sql("f")} AS ts FROM q0), q2 AS (SELECT *, {_acts_sql("ts")} AS every{_TAILS} FROM q1),
qp AS (SELECT qid, f AS qf, ts AS qts, CASE WHEN len(c0) > 0 THEN c0 WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 WHEN len(c3) > 0 THEN c3 ELSE every END AS acts, {_role("f", "subject")} AS subj, {_role("f", "legal_regime")} AS reg,
list_filter({_CONCEPTS}, lambda c: len(list_filter(c.p, lambda p: contains(f, p))) > 0) AS con, list_sort(list_concat(list_transform(list_filter({_FACETS}, lambda z: len(list_filter(z.p, lambda p: contains(f, p))) > 0), lambda z: z.f),
CASE WHEN regexp_matches(f, 'bao gom|liet ke|nhung gi|cac dieu kien') THEN ['LIST'] ELSE [] END, CASE WHEN {_has("f", answers.ORIGIN)} THEN ['RIGHT_ORIGIN'] ELSE [] END)) AS facets, {_has("f", answers.LEASE_TOO)} AS lease FROM q2)"""


def fit_sql(f: str, ts: str) -> str:
    """The fit of a text (folded, tokens) to the columns of `qp`."""
    found = f"len(list_filter(con, lambda c: len(list_filter(c.p, lambda p: contains({f}, p))) > 0))"
    hit = lambda role: f"CASE WHEN len(list_filter({role}, lambda p: contains({f}, p))) > 0 THEN 1 ELSE 0 END"
    asked = "(CASE WHEN len(subj) > 0 THEN 1 ELSE 0 END + CASE WHEN len(reg) > 0 THEN 1 ELSE 0 END + len(con))"
    odd = f"len(list_filter({_DISTINCT}, lambda d: contains({f}, d.p) AND len(list_filter(d.t, lambda x: NOT list_contains(qts, x))) > 0))"
    return (
        f"greatest(0.0::DOUBLE, 0.45::DOUBLE * len(list_intersect(qts, {ts})) / greatest(1, len(qts)) + CASE WHEN {acts_sql(ts)} THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN {asked} > 0 THEN 0.20::DOUBLE * ({hit('subj')} + {hit('reg')} + {found}) / {asked} ELSE 0 END"
        f" - least(0.30::DOUBLE, 0.10::DOUBLE * {odd}) - least(0.42::DOUBLE, 0.18::DOUBLE * (len(con) - {found})))"
    )


def acts_sql(ts: str) -> str:
    return f"len(list_filter({_ACTS}, lambda a: list_contains(acts, a.a) AND len(list_filter(a.t, lambda x: NOT list_contains({ts}, x))) = 0)) > 0"


_TOLD = f"{LAW}, told AS (SELECT * EXCLUDE (text), text || '. ' || {_list(SAID)}[k % {len(SAID)} + 1] AS text FROM law)"
_BENCH = f"bq AS (SELECT item_id AS qid, {_list(ASKED)}[item_id % {len(ASKED)} + 1] || ' ' || coalesce(text, '') AS question FROM benchmark)"


def told(places: DataFrame) -> DataFrame:
    """The statute with a phrase of law in each text."""
    return places.withColumn("text", F.concat("text", F.lit(". "), _pick(SAID, F.col("start_idx"))))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(_pick(ASKED, F.col("item_id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("question"))


def _profile_row(every: DataFrame, question_id: str) -> DataFrame:
    q = F.col("q")
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return every.select(question_id, *[joined(q[c]).alias(c) for c in ("tokens", "actions", "subject", "legal_regime", "concepts", "facets")], q["lease"].alias("lease"))


def _profile_cols(question_id: str) -> str:
    joined = lambda c, n: f"array_to_string(list_sort({c}), ',') AS {n}"
    return f"SELECT qid AS {question_id}, {joined('qts', 'tokens')}, {joined('acts', 'actions')}, {joined('subj', 'subject')}, {joined('reg', 'legal_regime')}, {joined('list_transform(con, lambda c: c.c)', 'concepts')}, {joined('facets', 'facets')}, lease FROM qp"


@query(f"WITH {_BENCH}, {profile_sql('bq')} {_profile_cols('question_id')}")
def question_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _profile_row(asked(spark, sf).select("question_id", answers.profile("question").alias("q")), "question_id")


_TURNS = f"SELECT row_number() OVER (ORDER BY conv_id, turn) AS qid, conv_id, turn, {_list(ASKED)}[(conv_id + turn) % {len(ASKED)} + 1] || ' ' || coalesce(text, '') AS question FROM conversations"


@query(f"WITH ct AS ({_TURNS}), {profile_sql('ct')} SELECT conv_id, turn, p.* EXCLUDE (qid) FROM ct JOIN ({_profile_cols('qid')}) p USING (qid)")
def turn_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """What each turn of the conversations asks for."""
    said = F.concat(_pick(ASKED, F.col("conv_id") + F.col("turn")), F.lit(" "), F.coalesce("text", F.lit("")))
    turns = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("qid"), answers.profile(said).alias("q"))
    return _profile_row(turns, "qid").select("qid.*", "*").drop("qid")


def _scores(texts: DataFrame, name: str) -> DataFrame:
    """All texts against each of the eight questions, which are read once and not with every text; eight rows go to all tasks."""
    asked = staged(texts.sparkSession.createDataFrame([(a,) for a in ASKED], "asked string").coalesce(1).select(answers.profile("asked").alias("q")), "asked")
    # a table of little bytes has few partitions, but its texts take long to read
    dealt = texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, name)
    d = dealt.select(name, answers.described("text", whole=False).alias("d"))
    # of a text's tokens those that a question has are kept: the others are in no question's fit
    words = asked.agg(F.array_distinct(F.flatten(F.collect_list("q.tokens"))).alias("words"))
    d = d.join(F.broadcast(words)).select(name, F.struct(F.array_intersect("d.tokens", "words").alias("tokens"), "d.marks", "d.actions", "d.concepts", "d.regimes").alias("d"))
    return d.join(F.broadcast(asked)).select(name, F.array_join(F.sort_array("q.tokens"), " ").alias("asked"), F.round(answers.fit(F.col("q"), F.col("d")), 6).alias("score"))


_ASKED_ROWS = "asked8 AS (SELECT unnest(range(" + str(len(ASKED)) + f")) AS qid, unnest({_list(ASKED)}) AS question)"


@query(f"WITH {_TOLD}, {_ASKED_ROWS}, {profile_sql('asked8')}, tx AS (SELECT id, {fold_sql('text')} AS f FROM told), ty AS (SELECT id, f, {tokens_sql('f')} AS ts FROM tx) SELECT id, array_to_string(list_sort(qts), ' ') AS asked, round({fit_sql('f', 'ts')}, 6)::DOUBLE AS score FROM ty CROSS JOIN qp")
def text_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How well the places of a statute fit eight questions."""
    return _scores(told(law(spark, sf)), "id")


@query(f"""WITH {_ASKED_ROWS}, {profile_sql('asked8')}, tx AS (SELECT doc_id, {fold_sql(f"coalesce(text, '') || '. ' || {_list(SAID)}[doc_id % {len(SAID)} + 1]")} AS f FROM documents),
ty AS (SELECT doc_id, f, {tokens_sql('f')} AS ts FROM tx) SELECT doc_id, array_to_string(list_sort(qts), ' ') AS asked, round({fit_sql('f', 'ts')}, 6)::DOUBLE AS score FROM ty CROSS JOIN qp""")
def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How well whole documents, each with a phrase of law after it, fit eight questions."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), _pick(SAID, F.col("doc_id"))).alias("text"))
    return _scores(d, "doc_id")


# A question looks at four articles: its own, the seventh, and two more.
_NEAR = "list_distinct([qid % 25 + 1, 7, qid * 3 % 15 + 1, qid * 7 % 15 + 1])"


def _near(q: Column) -> Column:
    return F.array_distinct(F.array(q % 25 + 1, F.lit(7).cast("long"), q * 3 % 15 + 1, q * 7 % 15 + 1))


def inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Questions with the places, references and children of four articles each."""
    places = law(spark, sf)
    nodes = told(places).withColumns({"locator": T.locator_of("id"), "parent_locator": T.locator_of("parent_id")})
    questions = asked(spark, sf).withColumn("traversal", F.col("question_id") % 3 > 0)
    near = questions.select("question_id", F.explode(_near(F.col("question_id"))).alias("number"))
    looked_at = staged(near.select("number").distinct(), "looked-at")  # articles that no question looks at give no row below
    own = staged(nodes.join(looked_at, "number", "left_semi").select("number", "id", "locator", "parent_locator", "text", F.col("start_idx").alias("place")), "looked-at-places")
    # as many rows as questions and their four articles
    mine = near.join(own, "number").drop("number", "id")
    refs = retrieve.reference_edges(places, articles=(5, 12), sources=places.join(looked_at, "number", "left_semi"))
    refs = refs.drop("source_text", "target_text").join(own.select(F.col("id").alias("source_id"), "number", F.col("place").alias("k"), F.col("text").alias("source_text")), "source_id")
    refs = staged(refs, "looked-at-references")
    said = nodes.select(F.col("locator").alias("target_locator"), F.col("text").alias("target_text")).join(refs.select("target_locator").distinct(), "target_locator", "left_semi")
    refs = refs.join(said.hint("merge"), "target_locator", "left")
    refs = refs.withColumn("target_locator", F.when(F.col("target_id").startswith("external:"), F.col("target_id")).otherwise(F.col("target_locator")))
    edges = near.join(refs.select("number", "source_locator", "relation_type", "target_locator", "source_text", "target_text", (F.col("k") * 4 + F.col("place")).alias("place")), "number").drop("number")
    anchors = mine.where(F.col("place") % 9 == F.col("question_id") % 9).select("question_id", "locator", "text", "place")
    liked = mine.where(F.col("place") % 13 == F.col("question_id") % 13).select("question_id", "locator")
    return {"questions": questions, "anchors": anchors, "edges": edges, "children": mine.where("parent_locator is not null").select("question_id", "parent_locator", "locator", "text", "place"), "preferred": liked}


_INPUTS = f"""{_TOLD}, {_TARGETS}, {_BENCH}, {profile_sql("bq")}, pl AS (SELECT k, locator, number, text, CASE WHEN k % 100 > 0 THEN regexp_replace(locator, ':[^:]*$', '') END AS up FROM told),
nr AS (SELECT qp.*, qid % 3 > 0 AS trav, unnest({_NEAR}) AS number FROM qp), mine AS (SELECT nr.qid, pl.* FROM nr JOIN pl USING (number)),
rf AS (SELECT source_locator AS src, CASE WHEN starts_with(target_id, 'external:') THEN target_id ELSE target_locator END AS dst, relation_type AS rel, s.number, s.k * 4 + place AS place, s.text AS stext, coalesce(d.text, '') AS dtext FROM ref JOIN pl s ON s.locator = source_locator LEFT JOIN pl d ON d.locator = target_locator),
ed AS (SELECT nr.* EXCLUDE (number), rf.* EXCLUDE (number) FROM nr JOIN rf USING (number)), an AS (SELECT qid, locator, text FROM mine WHERE k % 9 = qid % 9), li AS (SELECT qid, list(locator) AS liked FROM mine WHERE k % 13 = qid % 13 GROUP BY qid), al AS (SELECT qid, list(locator) AS near FROM an GROUP BY qid)"""

# What a place says: all its records agree here, so the order of the sources does not show.
_EDGES = f"""nt AS (SELECT qid, locator, min(text) AS text FROM (SELECT qid, locator, text FROM mine WHERE up IS NOT NULL OR k % 9 = qid % 9 UNION ALL SELECT qid, src, stext FROM ed UNION ALL SELECT qid, dst, dtext FROM ed) GROUP BY ALL),
e0 AS (SELECT ed.*, {fold_sql("stext || ' ' || coalesce(nt.text, '')")} AS sf, {fold_sql("dtext")} AS df FROM ed LEFT JOIN nt ON nt.qid = ed.qid AND contains(src, ':D') AND nt.locator = regexp_replace(src, ':[^:]*$', '') WHERE NOT starts_with(dst, 'external:')),
e1 AS (SELECT *, {tokens_sql("sf")} AS sts, {tokens_sql("df")} AS dts FROM e0),
e2 AS (SELECT *, {fit_sql("sf", "sts")} AS sfit, {fit_sql("df", "dts")} AS dfit, contains(sf, 'khi co du cac dieu kien') AS box, list_contains(facets, 'RIGHT_ORIGIN') AS origin, list_contains(facets, 'CONDITION') AS cond FROM e1),
e3 AS (SELECT *, CASE WHEN origin THEN 0.75::DOUBLE * sfit + 0.25::DOUBLE * dfit ELSE 0.40::DOUBLE * sfit + 0.60::DOUBLE * dfit END AS m FROM e2),
e4 AS (SELECT e3.*, CASE WHEN origin AND box THEN greatest(0, m - 0.30::DOUBLE) WHEN cond AND box THEN m + 0.32::DOUBLE ELSE m END AS sem, coalesce(len(list_filter(near, lambda a: a = src OR starts_with(a, src || ':') OR starts_with(src, a || ':'))), 0) > 0 AS isnear,
  coalesce(list_contains(liked, src) OR list_contains(liked, dst), false) AS isliked FROM e3 LEFT JOIN al USING (qid) LEFT JOIN li USING (qid)),
sc AS (SELECT *, round(0.50::DOUBLE * sem + CASE WHEN isnear THEN 0.22::DOUBLE ELSE 0 END + 0.15::DOUBLE * CASE WHEN cond AND rel = 'REQUIRES_CONDITION_FROM' THEN 1 WHEN list_contains(facets, 'EXCEPTION') AND rel = 'EXCEPTION_REFERENCE' THEN 1
  WHEN trav AND rel = 'INHERITS_RIGHTS_OBLIGATIONS' THEN 0.75 WHEN rel = 'DIRECT_REFERENCE' THEN 0.25 ELSE 0 END + CASE WHEN isliked THEN 0.08::DOUBLE ELSE 0 END + 0.05::DOUBLE * (CASE WHEN contains(src, ':K') THEN 1 ELSE 0 END + CASE WHEN contains(src, ':D') THEN 1 ELSE 0 END) / 2 + 1e-12, 6) AS score FROM e4)"""


@query()
def answer_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The references that each question may start from, scored."""
    x = inputs(spark, sf)
    own = x["questions"].select("question_id", answers.profile("question").alias("q"), "traversal")
    listed = lambda df, name: df.groupBy("question_id").agg(F.collect_set("locator").alias(name))
    own = own.join(listed(x["anchors"], "anchors"), "question_id", "left").join(listed(x["preferred"], "preferred"), "question_id", "left")
    own = own.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("anchors", "preferred")})
    texts = answers._node_texts(x["anchors"], None, x["children"], x["edges"])
    return answers.scored_edges(own, x["edges"], texts).select("question_id", "source_locator", "relation_type", "target_locator", "place", F.round("score", 4).alias("score"))


_KIDS = f"""k0 AS (SELECT mine.qid, up AS node, mine.locator AS dst, k AS place, {fold_sql("c.text")} AS cf, {fold_sql("coalesce(p.text, '')")} AS pf FROM mine JOIN nt c ON c.qid = mine.qid AND c.locator = mine.locator LEFT JOIN nt p ON p.qid = mine.qid AND p.locator = up WHERE up IS NOT NULL),
k1 AS (SELECT k0.*, {tokens_sql("cf")} AS cts, EXISTS (SELECT 1 FROM sc WHERE sc.qid = k0.qid AND sc.src = k0.dst) AS link FROM k0), k2 AS (SELECT k1.*, qp.* EXCLUDE (qid), liked, list_contains(facets, 'CONDITION') AS cond FROM k1 JOIN qp USING (qid) LEFT JOIN li USING (qid)),
kd AS (SELECT qid, node, dst, 'PARENT_CHILD_CONTEXT' AS typ, place, 0.55::DOUBLE * {fit_sql("cf", "cts")} + CASE WHEN link THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN coalesce(list_contains(liked, dst) OR list_contains(liked, node), false) THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN cond AND (contains(cf, 'dieu kien') OR contains(cf, 'phai') OR contains(cf, 'da ') OR contains(cf, 'co ')) THEN 0.10::DOUBLE ELSE 0 END AS v, false AS edge, link, {acts_sql("cts")} AS act, cond AND (contains(cf, 'khi co du cac dieu kien') OR contains(cf, 'dieu kien sau day')) AS box,
  CASE WHEN contains(cf, 'quyen thue trong hop dong') = lease THEN 0.45::DOUBLE ELSE -0.45::DOUBLE END AS lf, cond, (contains(pf, 'khi co du cac dieu kien') OR contains(pf, 'dieu kien sau day')) AND NOT contains(pf, 'quyen thue trong hop dong') AS whole, lease AND contains(pf, 'quyen thue trong hop dong') AS lonly FROM k2),
mv AS (SELECT qid, src AS node, dst, rel AS typ, place, score AS v, true AS edge, false AS link, false AS act, false AS box, 0.0::DOUBLE AS lf, false AS cond, false AS whole, false AS lonly FROM sc UNION ALL SELECT * FROM kd),
rt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place) AS n FROM sc WHERE score > 0 QUALIFY n <= 12),
p1 AS (SELECT qid, [n] AS trail, dst AS node, [src, dst] AS seen, [src || ' ' || rel || ' ' || dst] AS steps, score AS total, min(score) OVER (PARTITION BY qid, src, rel, dst) AS root FROM rt)"""


def _step_sql(i: int) -> str:
    """Paths p{i} to p{i + 1}, and those that end, d{i}."""
    return f"""a{i} AS (SELECT p.qid, p.trail, p.seen, p.steps, p.total, p.root, mv.* EXCLUDE (qid), max(edge::INT) OVER (PARTITION BY p.qid, p.trail) AS anyedge FROM p{i} p JOIN mv ON mv.qid = p.qid AND mv.node = p.node AND NOT list_contains(p.seen, mv.dst)),
b{i} AS (SELECT *, row_number() OVER (PARTITION BY qid, trail ORDER BY v DESC, place) AS n, row_number() OVER (PARTITION BY qid, trail ORDER BY act DESC, v DESC, place) AS na, row_number() OVER (PARTITION BY qid, trail ORDER BY box DESC, v + lf DESC, v DESC, place) AS nb,
  max(box::INT) OVER (PARTITION BY qid, trail) AS anybox, max(act::INT) OVER (PARTITION BY qid, trail) AS anyact FROM a{i} WHERE edge::INT = anyedge),
c{i} AS (SELECT *, max(link::INT) OVER (PARTITION BY qid, trail) AS anylink FROM b{i} WHERE CASE WHEN edge THEN n <= 2 WHEN anybox = 1 THEN nb = 1 WHEN anyact = 1 THEN act AND na <= 2 WHEN cond THEN whole OR (v >= 0.10 AND n <= 5) ELSE v >= 0.22 AND n <= 2 END),
p{i + 1} AS (SELECT qid, list_append(trail, n) AS trail, dst AS node, list_append(seen, dst) AS seen, list_append(steps, node || ' ' || typ || ' ' || dst) AS steps, total + v AS total, root FROM c{i} WHERE edge OR NOT (lonly AND anylink = 1) OR link),
d{i} AS (SELECT p.* FROM p{i} p ANTI JOIN (SELECT DISTINCT qid, trail[:-2] AS trail FROM p{i + 1}) g ON g.qid = p.qid AND g.trail = p.trail)"""


_PATHS = ", ".join(_step_sql(i) for i in range(1, 6)) + ", done AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(1, 6)) + " UNION ALL SELECT * FROM p6)"


@query(f"""WITH {_INPUTS}, {_EDGES}, {_KIDS}, {_PATHS}, one AS (SELECT qid, steps, max(total) AS total, min(trail) AS trail, max(root) AS root FROM done GROUP BY qid, steps),
wh AS (SELECT * FROM one ANTI JOIN (SELECT DISTINCT qid, steps[:n] AS steps FROM (SELECT qid, steps, unnest(range(1, len(steps))) AS n FROM one)) h USING (qid, steps)),
rk AS (SELECT *, round(0.70::DOUBLE * root + 0.30::DOUBLE * (total - root) / greatest(1, len(steps) - 1), 9) AS score FROM wh), bs AS (SELECT *, first_value(steps[1]) OVER w AS best FROM rk WINDOW w AS (PARTITION BY qid ORDER BY score DESC, len(steps) DESC, trail)),
pl2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, len(steps) DESC, trail) AS place FROM bs WHERE steps[1] = best)
SELECT qid AS question_id, place::INTEGER AS place, round(score, 6)::DOUBLE AS score, array_to_string(steps, ' | ') AS steps FROM pl2 WHERE place <= 6""")
def answer_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The best start of each question and its paths."""
    paths, _ = answers.answer_paths(**inputs(spark, sf))
    said = F.array_join(F.transform("steps", lambda s: F.concat_ws(" ", s["source"], s["type"], s["target"])), " | ")
    return paths.select("question_id", "place", F.round("score", 6).alias("score"), said.alias("steps"))


@query(f"""WITH {_INPUTS}, {_EDGES}, {_KIDS}, {_PATHS} SELECT rt.qid AS question_id, n::INTEGER AS place, src AS source_locator, rel AS relation_type, dst AS target_locator, score::DOUBLE AS score, c.completed
FROM rt JOIN (SELECT qid, trail[1] AS n, count(*) AS completed FROM done GROUP BY ALL) c USING (qid, n)""")
def answer_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve starts of each question, with the number of paths from each."""
    _, starts = answers.answer_paths(**inputs(spark, sf))
    return starts.select("question_id", "place", "source_locator", "relation_type", "target_locator", "score", "completed")
