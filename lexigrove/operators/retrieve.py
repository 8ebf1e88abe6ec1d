"""Retrieval: lexical and vector search, bounded traversal, pruning, ranking, and context under a budget."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import dropped, partitions, staged
from .graph import ancestors
from .route import cached, cosine

# Lexical and vector search.
ARTICLE_BOOST, K1, B = 8.0, 1.2, 0.75


def _is(token: str):
    return lambda t: t == token


def bm25(docs: DataFrame, query: list[str], k: int | None = 10, boosted: Column | None = None, id_col: str = "node_id", tokens: str = "tokens", k1: float = K1, b: float = B) -> DataFrame:
    """(id, lexical_score, score): the k best by BM25; ties go to the smaller id. `boosted`: rows that name an article asked for.

    Only the query's tokens are counted, in place, so a document is one row until the end: no token is exploded, and the
    corpus statistics are one small aggregation. `query` is a list of distinct tokens.
    """
    query = list(dict.fromkeys(query))
    # the tokens are bound once: a plain projection would make them anew for each count
    bound = F.transform(F.array(F.col(tokens)), lambda t: F.struct(F.size(t).alias("n"), *[F.size(F.filter(t, _is(q))).alias(f"tf{i}") for i, q in enumerate(query)]))
    counts = docs.select(id_col, F.get(bound, F.lit(0)).alias("c"), (boosted if boosted is not None else F.lit(False)).alias("boosted"))
    counts = staged(counts.select(id_col, "c.*", "boosted"), "bm25-counts")
    stats = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    s = stats.first()  # one row
    if not s["docs"] or not query:
        return docs.select(id_col, F.lit(0.0).alias("lexical_score"), F.lit(0.0).alias("score")).limit(0)
    length = F.greatest(F.lit(1), F.col("n")) / max(1.0, s["avg_n"])
    total = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(F.lit(1 + (s["docs"] - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5)))
        tf = F.col(f"tf{i}")
        total = total + F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length))).otherwise(0.0)
    total = total + F.when(F.col("boosted"), F.lit(ARTICLE_BOOST)).otherwise(0.0)
    scored = counts.select(id_col, total.alias("lexical_score")).where("lexical_score > 0")
    best = scored.orderBy(F.desc("lexical_score"), id_col)
    if k is not None:
        best = best.limit(k)
    top = F.max("lexical_score").over(Window.partitionBy())  # over k rows
    return best.withColumn("score", F.col("lexical_score") / top) if k is not None else best.withColumn("score", F.col("lexical_score"))


def _counted(tokens: Column) -> Column:
    """The distinct tokens of an array with their counts, structs (token, tf): runs of the sorted array."""

    def told(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))
        return F.get(F.transform(F.array(starts), lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("long").alias("tf")))), F.lit(0))

    return F.when(F.size(tokens) > 0, F.get(F.transform(F.array(F.sort_array(tokens)), told), F.lit(0)))


def lexical_index(nodes: DataFrame, path: str, key: str, parts: int = 64) -> str:
    """Postings and lengths of the tokens of nodes (id, title, text), kept at `path` for all questions; made anew for another `key`.

    Postings (token, node_id, tf, n) lie in folders by a hash of the token, sorted by it, so a question reads those of its tokens alone.
    Nodes without a token are in neither table.
    """
    spark = nodes.sparkSession

    def lengths() -> DataFrame:
        tokens = T.lexical_tokens(F.concat_ws(" ", "title", "text"))
        bound = F.get(F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("n"), _counted(t).alias("terms"))), F.lit(0))
        counts = staged(nodes.select(F.col("id").alias("node_id"), bound.alias("c")).select("node_id", "c.*"), "lexical-counts")
        each = counts.select("node_id", "n", F.explode("terms").alias("t")).select("node_id", "n", "t.*")
        # counted in its row, a posting is moved once: the folder and a share of its nodes tell the task
        each = each.withColumns({"part": F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"), "share": F.pmod(F.xxhash64("node_id"), F.lit(8))}).repartition("part", "share")
        postings = each.groupBy("part", "share", "token", "node_id").agg(F.sum("tf").alias("tf"), F.max("n").alias("n"))
        postings.sortWithinPartitions("part", "token").select("token", "node_id", "tf", "n", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        s = counts.where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n")).first()  # one row
        dropped(counts)
        return spark.createDataFrame([(s["docs"], s["avg_n"], parts)], "docs long, avg_n double, parts int")

    cached(f"{path}/lengths", key, lengths, spark)
    return path


def bm25_indexed(spark: SparkSession, path: str, query: list[str], k: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(node_id, lexical_score): the k best by BM25 from a `lexical_index`, or all if k is None; ties go to the smaller id."""
    query = list(dict.fromkeys(query))
    s = spark.read.parquet(f"{path}/lengths/data").first()  # one row
    where = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(q)), F.lit(s["parts"])).alias(f"p{i}") for i, q in enumerate(query)]).first() if query else []
    found = spark.read.parquet(f"{path}/postings").where(F.col("part").isin([int(x) for x in where]) & F.col("token").isin(query))
    df = found.groupBy("token").agg(F.count("*").alias("df"))  # one row for each token of the question
    idf = F.log(1 + (s["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    score = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("n") / max(1.0, s["avg_n"])))
    scored = found.join(F.broadcast(df), "token").groupBy("node_id").agg(F.sum(score).alias("lexical_score"))
    return scored if k is None else scored.orderBy(F.desc("lexical_score"), "node_id").limit(k)


def article_boost(question: str, node_id: str = "node_id") -> Column:
    """Rows whose id names an article that the question names."""
    named = sorted(set(re.findall(r"(?:điều|dieu)\s+(\d+)", question.casefold())))
    return F.col(node_id).rlike("_dieu-(?:" + "|".join(named) + r")(?!\d)") if named else F.lit(False)


def vector_top(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "node_id", vector: str = "embedding") -> DataFrame:
    """(id, score): the k nearest by cosine, exact. Each task keeps k rows; ties go to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def merged(lexical: DataFrame, vector: DataFrame, k: int, slots: int = 4, id_col: str = "node_id") -> DataFrame:
    """Up to `slots` lexical rows first, then the vector rows, each id once, k in all: (id, score, retrieval_source, place)."""
    place = lambda df, source, offset: df.select(id_col, "score", F.lit(source).alias("retrieval_source"), (F.row_number().over(Window.orderBy(F.desc("score"), id_col)) + offset).alias("place"))  # noqa: E731  over at most k rows
    both = place(lexical, "LEXICAL", 0).where(F.col("place") <= slots).unionByName(place(vector, "VECTOR", slots))
    first = both.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy("place"))).where("__n = 1").drop("__n")
    return first.orderBy("place").limit(k)


# Traversal. Nodes: (id, type, parent_id, position, title, text); edges: (source, target, type).
def distinct_ids(ids: list[str]) -> list[str]:
    if any(not isinstance(i, str) or not i.strip() for i in ids):
        raise ValueError("anchor ids are texts that are not blank")
    return list(dict.fromkeys(ids))


def _ids(spark, ids: list[str], name: str = "id") -> DataFrame:
    return spark.createDataFrame([(i, n) for n, i in enumerate(distinct_ids(ids))], f"{name} string, place int")


def parents(nodes: DataFrame, ids: list[str], limit: int = 30, levels: int = 3) -> DataFrame:
    found = ancestors(nodes, levels).join(F.broadcast(_ids(nodes.sparkSession, ids)), "id").groupBy("ancestor").agg(F.min("distance").alias("graph_distance"))
    return nodes.join(found.withColumnRenamed("ancestor", "id"), "id").orderBy("graph_distance", "id").limit(limit)


def children(nodes: DataFrame, ids: list[str], limit: int = 100) -> DataFrame:
    return nodes.join(F.broadcast(_ids(nodes.sparkSession, ids, "parent_id").drop("place")), "parent_id").orderBy("position", "id").limit(limit)


def below(nodes: DataFrame, ids: list[str], levels: int = 2, limit: int = 200) -> DataFrame:
    if not 1 <= levels <= 2:
        raise ValueError("descendants go one or two levels down")
    found = ancestors(nodes, levels).join(F.broadcast(_ids(nodes.sparkSession, ids, "ancestor").drop("place")), "ancestor").groupBy("id").agg(F.min("distance").alias("graph_distance"))
    return nodes.join(found, "id").orderBy("graph_distance", "position", "id").limit(limit)


# Words that mark an exception.
EXCEPTION_MARKS = ["trừ trường hợp", "trừ ", "ngoại lệ", "không được", "chỉ được"]


def exceptions(nodes: DataFrame, ids: list[str], limit: int = 50) -> DataFrame:
    marks = F.lit(False)
    for m in EXCEPTION_MARKS:
        marks = marks | F.contains(F.lower("text"), F.lit(m))
    return children(nodes, ids, limit=10_000).where(marks).orderBy("position", "id").limit(limit)


def physical(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return nodes.join(F.broadcast(_ids(nodes.sparkSession, ids)), "id").orderBy("place").drop("place")


def norms_of(nodes: DataFrame, edges: DataFrame, norms: DataFrame, ids: list[str], limit: int = 50) -> DataFrame:
    """Norms that the anchors, or nodes up to three levels below, mention: (anchor_id, source_id, norm_id, roles as sorted lists).

    An anchor's own norms hide those of its descendants.
    """
    start = F.broadcast(_ids(nodes.sparkSession, ids, "anchor_id"))
    reach = start.select("anchor_id", "place", F.col("anchor_id").alias("source_id"), F.lit(0).alias("distance")).unionByName(ancestors(nodes, 3).join(start.withColumnRenamed("anchor_id", "ancestor"), "ancestor").select(F.col("ancestor").alias("anchor_id"), "place", F.col("id").alias("source_id"), "distance"))
    told = edges.where("type = 'MENTIONS'").select(F.col("source").alias("source_id"), F.col("target").alias("norm_id"))
    hits = reach.join(told, "source_id").join(norms.select(F.col("id").alias("norm_id"), "modality"), "norm_id")
    own = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("anchor_id"))
    hits = hits.withColumn("__own", own).where((F.col("__own") == 0) | (F.col("distance") == 0))
    roles = edges.where(F.col("type").startswith("HAS_")).groupBy(F.col("source").alias("norm_id")).agg(*[F.sort_array(F.collect_set(F.when(F.col("type") == t, F.col("target")))).alias(c) for t, c in {"HAS_SUBJECT": "subjects", "HAS_ACTION": "actions", "HAS_OBJECT": "objects", "HAS_CONDITION": "conditions", "HAS_EXCEPTION": "exceptions", "HAS_CONSEQUENCE": "consequences"}.items()])
    return hits.join(roles, "norm_id", "left").orderBy("place", "distance", "norm_id").limit(limit).drop("__own")


def neighbourhood(edges: DataFrame, ids: list[str], hops: int = 2, limit: int = 100) -> DataFrame:
    """Undirected paths of 1 to `hops` edges from the ids, none used twice: (start, nodes, edges). One join for each hop."""
    if not 1 <= hops <= 3:
        raise ValueError("one to three hops")
    keyed = edges.withColumn("edge", F.concat_ws("|", "source", "type", "target"))
    both = keyed.select(F.col("source").alias("at"), F.col("target").alias("to"), "edge").unionByName(keyed.select(F.col("target").alias("at"), F.col("source").alias("to"), "edge"))
    step = F.broadcast(_ids(edges.sparkSession, ids, "start").drop("place")).withColumns({"at": F.col("start"), "nodes": F.array("start"), "edges": F.array().cast("array<string>")})
    out = None
    for _ in range(hops):
        step = step.join(both, "at").where(~F.array_contains("edges", F.col("edge"))).select("start", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))
        out = step if out is None else out.unionByName(step)
    return out.select("start", "nodes", "edges").orderBy(F.size("edges"), F.array_join("nodes", "|"), F.array_join("edges", "|")).limit(limit)


# References in text.
# The forms of a reference.
FORMS = re.compile(r"điểm\s+(?P<p>[a-zđ])\s+khoản\s+(?P<pk>\d+)\s+Điều\s+(?P<pa>\d+)|khoản\s+(?P<ks>\d+(?:\s*(?:,|và)\s*khoản\s+\d+)*)\s+Điều\s+(?P<ka>\d+)|Điều\s+(?P<as>\d+(?:\s*(?:,|và)\s*Điều\s+\d+)*)", re.I)
THIS_FORMS = (re.compile(r"điểm\s+([a-zđ])\s+khoản\s+(\d+)\s+Điều\s+này", re.I), re.compile(r"khoản\s+(\d+)\s+Điều\s+này", re.I), re.compile(r"điểm\s+([a-zđ])\s+khoản\s+này", re.I))
RELATION_WORDS = [(("trừ trường hợp", "ngoại lệ"), "EXCEPTION_REFERENCE"), (("điều kiện quy định tại", "phải đáp ứng"), "REQUIRES_CONDITION_FROM"), (("quyền và nghĩa vụ", "tương ứng"), "INHERITS_RIGHTS_OBLIGATIONS")]


def reference_locators(text: str, source: str | None, law: str = "LD2024", articles: tuple[int, int] = (26, 48)) -> list[tuple[str, str]]:
    """(target, relation type) for the places that a text names: points, then clauses, then articles, then "this ..".

    A place inside a longer form counts with it alone. The range of articles that are not external is a parameter.
    """
    by_kind: dict[str, list[str]] = {"point": [], "clause": [], "article": []}
    for m in FORMS.finditer(text):
        if m["p"]:
            by_kind["point"].append(f"{law}:A{m['pa']}:K{m['pk']}:D{m['p'].casefold()}")
        elif m["ks"]:
            by_kind["clause"] += [f"{law}:A{m['ka']}:K{k}" for k in re.findall(r"\d+", m["ks"])]
        else:
            by_kind["article"] += [f"{law}:A{a}" for a in re.findall(r"\d+", m["as"])]
    own = re.fullmatch(rf"{law}:A(\d+)(?::K(\d+))?(?::D[a-zđ])?", source or "")
    here: list[str] = []
    if own:
        here += [f"{law}:A{own[1]}:K{m[2]}:D{m[1].casefold()}" for m in THIS_FORMS[0].finditer(text)]
        here += [f"{law}:A{own[1]}:K{m[1]}" for m in THIS_FORMS[1].finditer(text)]
        if own[2]:
            here += [f"{law}:A{own[1]}:K{own[2]}:D{m[1].casefold()}" for m in THIS_FORMS[2].finditer(text)]
    lowered = text.casefold()
    inner = next((kind for words, kind in RELATION_WORDS if any(w in lowered for w in words)), "DIRECT_REFERENCE")
    targets = dict.fromkeys(t for t in (*by_kind["point"], *by_kind["clause"], *by_kind["article"], *here) if t != source)
    within = lambda t: articles[0] <= int(re.search(r":A(\d+)", t)[1]) <= articles[1]
    return [(t, inner if within(t) else "EXTERNAL_REFERENCE") for t in targets]


def reference_edges(nodes: DataFrame, law: str = "LD2024", articles: tuple[int, int] = (26, 48), sources: DataFrame | None = None) -> DataFrame:
    """(source_id, source_locator, source_text, target_locator, relation_type, target_id, target_text, place) for all nodes.

    sources: the nodes whose texts are read, where only their references are asked for; targets are found among all nodes. Texts that name no article, clause or point do not reach the UDF. Places that are no node have the id `external:..`.
    """
    told = lambda df: df.withColumns({"locator": T.locator_of("id", law), "said": F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.trim("title"))})
    named = told(nodes).where("locator is not null")

    @F.pandas_udf("array<struct<target:string,relation:string>>")
    def found(texts: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([[{"target": t, "relation": r} for t, r in reference_locators(x or "", s, law, articles)] for x, s in zip(texts, sources)])

    some = (named if sources is None else told(sources)).where(F.col("locator").isNotNull() & F.col("said").rlike(r"(?iu)điều|khoản|điểm"))
    out = some.select(F.col("id").alias("source_id"), F.col("locator").alias("source_locator"), F.col("said").alias("source_text"), F.posexplode(found("said", "locator")).alias("place", "r"))
    out = staged(out.withColumns({"target_locator": F.col("r.target"), "relation_type": F.col("r.relation")}).drop("r"), "reference-places")
    # places that nothing refers to are neither sorted nor moved
    wanted = named.join(out.select(F.col("target_locator").alias("locator")).distinct(), "locator", "left_semi")
    last = "start_idx" if "start_idx" in nodes.columns else "id"
    targets = wanted.groupBy(F.col("locator").alias("target_locator")).agg(F.max_by("id", last).alias("target_id"), F.max_by("said", last).alias("target_text"))
    out = out.join(targets.hint("merge"), "target_locator", "left")
    return out.withColumns({"target_id": F.coalesce("target_id", F.concat(F.lit("external:"), "target_locator")), "target_text": F.coalesce("target_text", F.lit(""))})


def typed_paths(nodes: DataFrame, references: DataFrame, ids: list[str], hops: int = 1, limit: int = 100) -> DataFrame:
    """Reference edges from the anchors and their children, and with two hops from the targets and theirs, each once."""
    if not 1 <= hops <= 2:
        raise ValueError("one or two hops")
    start = _ids(nodes.sparkSession, ids).select("id", F.col("place").cast("long").alias("order"))
    kids = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("up"), F.col("position").cast("long").alias("position"))

    def with_children(front: DataFrame) -> DataFrame:
        more = front.withColumnRenamed("id", "up").join(kids, "up").select("id", (F.col("order") * 1000 + F.col("position")).alias("order"))
        return front.select("id", (F.col("order") * 1000).alias("order")).unionByName(more).groupBy("id").agg(F.min("order").alias("order"))

    front, out = with_children(start), None
    for hop in range(1, hops + 1):
        step = references.join(front.withColumnRenamed("id", "source_id"), "source_id").withColumn("hop", F.lit(hop))
        out = step if out is None else out.unionByName(step)
        front = with_children(step.where(~F.col("target_id").startswith("external:")).select(F.col("target_id").alias("id"), "order").groupBy("id").agg(F.min("order").alias("order")))
    same = Window.partitionBy("source_locator", "relation_type", "target_locator").orderBy("hop", "order", "place")
    return out.withColumn("__n", F.row_number().over(same)).where("__n = 1").orderBy("hop", "order", "place").limit(limit).drop("__n", "order")


# Questions.
# Phrases by action and facet, and patterns by signal.
ACTIONS = ["chuyển đổi", "chuyển nhượng", "cho thuê lại", "cho thuê", "thế chấp", "góp vốn", "tặng cho", "thừa kế", "bán tài sản", "đăng ký", "khấu trừ"]
FACETS = {
    "CONDITION": ["điều kiện", "đáp ứng", "khi có đủ", "phải"],
    "EXCEPTION": ["ngoại lệ", "trừ trường hợp", "không áp dụng", "chỉ được"],
    "SUBJECT": ["ai", "chủ thể", "đối tượng", "tổ chức", "cá nhân", "người"],
    "RECIPIENT": ["tại ai", "cho ai", "bên nhận", "tổ chức tín dụng", "ngân hàng"],
}
LIST_PATTERN = "bao gom|liet ke|nhung gi|cac dieu kien"
QUESTION_SIGNALS = {
    "LIST_REQUEST": r"các điều kiện|bao gồm những gì|nội dung chính|các trường hợp|những quyền|nghĩa vụ nào|liệt kê",
    "REFERENCE_REQUEST": r"theo điều|quy định tại|ngoài điều kiện|quyền và nghĩa vụ tương ứng|dẫn chiếu",
    "EXCEPTION_REQUEST": r"trừ trường hợp|ngoại lệ|không được|chỉ được|bị cấm|hạn chế",
    "SUBJECT_REQUEST": r"\bai\b|đối tượng nào|tổ chức nào|cá nhân nào|chủ thể|có được phép",
    "COMPARISON_REQUEST": r"so sánh|khác nhau|phân biệt|tương ứng",
    "MULTI_HOP_REQUEST": r"đồng thời|và các điều kiện|quyền và nghĩa vụ chung|theo các điều",
}
SIGNAL_FEATURES = {
    "LIST_REQUEST": ["requires_all_children"],
    "REFERENCE_REQUEST": ["requires_reference_traversal"],
    "EXCEPTION_REQUEST": ["requires_exception"],
    "SUBJECT_REQUEST": ["requires_subject_resolution", "requires_parent_context"],
    "COMPARISON_REQUEST": ["requires_comparison"],
    "MULTI_HOP_REQUEST": ["requires_reference_traversal", "requires_multi_hop"],
}
FEATURES = ["requires_all_children", "requires_reference_traversal", "requires_exception", "requires_subject_resolution", "requires_parent_context", "requires_multi_hop", "requires_comparison"]
FALLBACK_FEATURES = ["requires_parent_context", "requires_reference_traversal", "requires_subject_resolution"]


def folded(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d")


def question_tokens(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9]+", folded(text)) if len(t) > 2 and t not in T.QUESTION_STOPWORDS))


def requested_facets(question: str) -> set[str]:
    q = folded(question)
    return {f for f, phrases in FACETS.items() if any(folded(p) in q for p in phrases)} | ({"LIST"} if re.search(LIST_PATTERN, q) else set())


def _says(text: Column, words: list[str]) -> Column:
    """Whether a text contains any of the words. (A lambda could not hold the UDF that folds the text.)"""
    return functools.reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def facets_of(text: str) -> Column:
    """The facets that a question column asks for, as a sorted array."""
    q = T.fold(text)
    each = [F.when(_says(q, [folded(p) for p in phrases]), F.lit(f)) for f, phrases in FACETS.items()]
    return F.sort_array(F.array_compact(F.array(*each, F.when(q.rlike(LIST_PATTERN), F.lit("LIST")))))


def signals_of(text: str) -> Column:
    """The signals of a question column, in a fixed order."""
    q = F.lower(F.col(text))
    return F.array_compact(F.array(*[F.when(q.rlike("(?U)" + p), F.lit(n)) for n, p in QUESTION_SIGNALS.items()]))


def features_of(signals: Column) -> Column:
    table = F.create_map(*[x for n, fs in SIGNAL_FEATURES.items() for x in (F.lit(n), F.array(*map(F.lit, fs)))])
    return F.array_distinct(F.flatten(F.transform(signals, lambda s: table[s])))


def policy(rule_features: Column, probabilities: Column, fallback: bool = False, activate: float = 0.60, uncertain: float = 0.40, reference: float = 0.35) -> Column:
    """struct(activated, uncertain): features that rules or probabilities (a map) turn on; uncertain ones are on as well."""
    p = lambda f: F.coalesce(probabilities[f], F.lit(0.0))
    on = lambda f: F.array_contains(rule_features, f) | (p(f) >= min(uncertain, reference if f == "requires_reference_traversal" else activate)) | F.lit(fallback and f in FALLBACK_FEATURES)
    return F.struct(F.array_compact(F.array(*[F.when(on(f), F.lit(f)) for f in FEATURES])).alias("activated"), F.array_compact(F.array(*[F.when((p(f) >= uncertain) & (p(f) < activate), F.lit(f)) for f in FEATURES])).alias("uncertain"))


# Pruning and ranking.
def _overlap(tokens: Column, query: list[str]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, query)).cast("array<string>"))) / max(1, len(query))


def path_scores(question: str, paths: DataFrame, anchors: list[str]) -> DataFrame:
    """Paths with `score`: overlap with the question, whether the ends are in the anchors' articles, and the hop."""
    locators = [x for x in anchors if x]
    article = lambda c: F.regexp_extract(c, r"^(\w+:A\d+)", 1)
    seeds = sorted({re.match(r"\w+:A\d+", x)[0] for x in locators if re.match(r"\w+:A\d+", x)})
    seed = lambda c: (F.col(c).isin(locators) | article(F.col(c)).isin(seeds)).cast("double") if locators else F.lit(0.0)
    overlap = _overlap(T.token_set(F.concat_ws(" ", "source_text", "target_text")), question_tokens(question))
    score = 0.55 * overlap + 0.30 * seed("source_locator") + 0.10 * seed("target_locator") + 0.05 / F.greatest(F.lit(1), F.coalesce("hop", F.lit(1)))
    return paths.withColumn("score", F.round(score, 6))


def prune_paths(question: str, paths: DataFrame, anchors: list[str], keep: int = 3) -> DataFrame:
    """At most `keep` paths, each the best that hangs together with what is reached so far.

    Scores are computed in the cluster; the choice is a loop over the best paths, of which there are at most 240.
    """
    scored = path_scores(question, paths, anchors)
    rows = scored.orderBy(F.desc("score"), F.coalesce("hop", F.lit(1)), "source_locator", "relation_type", "target_locator").limit(240).collect()
    within = lambda a, b: a == b or a.startswith(b + ":") or b.startswith(a + ":")
    reached, chosen, left = {a for a in anchors if a}, [], list(rows)
    while left and len(chosen) < keep:
        row = next((r for r in left if any(within(r["source_locator"], x) for x in reached)), left[0])
        left = [r for r in left if (r["source_locator"], r["relation_type"], r["target_locator"]) != (row["source_locator"], row["relation_type"], row["target_locator"])]
        chosen.append(row)
        reached.add(row["target_locator"])
    return paths.sparkSession.createDataFrame(chosen, scored.schema)


def select_children(question: str, rows: DataFrame, parents_: list[str], all_children: bool = False, per_parent: int = 5) -> DataFrame:
    """Children (node_id, parent_locator, position, text) of relevant parents: the best of each over a threshold, at least one."""
    q, facets = folded(question), requested_facets(question)
    acts = [folded(a) for a in ACTIONS if folded(a) in q]
    said = T.fold("text")
    any_of = lambda words: _says(said, words).cast("double") if words else F.lit(0.0)
    score = (
        0.40 * any_of(acts) + 0.25 * _overlap(T.token_set("text"), question_tokens(question))
        + 0.15 * (any_of(["dieu kien", "phai", "da ", "co "]) if "CONDITION" in facets else F.lit(0.0))
        + 0.10 * (any_of(["tru ", "khong duoc", "chi duoc"]) if "EXCEPTION" in facets else F.lit(0.0))
        + 0.10 * F.col("parent_locator").isin(parents_).cast("double")
    )
    threshold = 0.10 if all_children and "LIST" in facets else 0.25
    ranked = rows.withColumn("score", F.round(score, 6)).where(F.col("parent_locator").isin(parents_))
    n = F.row_number().over(Window.partitionBy("parent_locator").orderBy(F.desc("score"), "position", "node_id"))
    return ranked.withColumn("__n", n).where((F.col("__n") == 1) | ((F.col("__n") <= per_parent) & (F.col("score") >= threshold))).drop("__n")


# What a source is worth when the same text comes from several.
SOURCE_PRIORITY = {"NORM": 1.0, "REFERENCE_TARGET": 0.95, "ANCHOR": 0.9, "EXCEPTION": 0.9, "CHILD": 0.85, "PARENT": 0.8, "REFERENCE_SOURCE": 0.8, "PHYSICAL_FALLBACK": 0.75}
CANDIDATE = "node_id STRING, canonical_locator STRING, text STRING, source_type STRING, vector_score DOUBLE, graph_distance INT, relation_type STRING, roles ARRAY<STRING>, source_locator STRING, target_locator STRING, exact_provenance BOOLEAN"


def candidates(records: DataFrame, source_type: str, law: str = "LD2024") -> DataFrame:
    """Records of any source to the schema CANDIDATE; those without id or text go."""
    have = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in records.columns], F.lit(None).cast("string"))
    opt = lambda n, t: F.col(n).cast(t) if n in records.columns else F.lit(None).cast(t)
    node, text = have("node_id", "anchor_id", "id"), have("text", "evidence", "anchor_text")
    locator = F.coalesce(have("canonical_locator"), T.locator_of(node, law))
    roles = F.coalesce(opt("roles", "array<string>"), norm_roles(records) if source_type == "NORM" else F.array(F.lit(source_type)))
    out = records.select(
        node.alias("node_id"), locator.alias("canonical_locator"), text.alias("text"), F.lit(source_type).alias("source_type"), opt("score", "double").alias("vector_score"), F.coalesce(opt("graph_distance", "int"), F.lit(0)).alias("graph_distance"),
        opt("relation_type", "string").alias("relation_type"), roles.alias("roles"), opt("source_locator", "string").alias("source_locator"), opt("target_locator", "string").alias("target_locator"), locator.isNotNull().alias("exact_provenance"),
    )
    return out.where("node_id is not null and text is not null")


def norm_roles(records: DataFrame) -> Column:
    """Names of the roles that a norm record has, else NORM."""
    names = {"subjects": "SUBJECT", "actions": "ACTION", "objects": "OBJECT", "conditions": "CONDITION", "exceptions": "EXCEPTION", "consequences": "CONSEQUENCE"}
    found = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(n)) for c, n in names.items() if c in records.columns], F.lit(None).cast("string")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("NORM")))


def collect(sources: dict[str, DataFrame], paths: DataFrame | None = None, law: str = "LD2024") -> DataFrame:
    """All records as candidates, and both ends of the paths."""
    parts = [candidates(df, s, law) for s, df in sources.items()]
    if paths is not None:
        for end in ("source", "target"):
            ends = paths.select(F.col(f"{end}_id").alias("node_id"), F.col(f"{end}_text").alias("text"), F.col(f"{end}_locator").alias("canonical_locator"), "relation_type", "source_locator", "target_locator", F.col("hop").alias("graph_distance"))
            parts.append(candidates(ends, f"REFERENCE_{end.upper()}", law))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank(question: str, found: DataFrame, limit: int | None = 12) -> DataFrame:
    """Candidates once for each place and text, the best source first, by rank_score."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])[F.col("source_type")], F.lit(0.0))
    same = Window.partitionBy(F.coalesce("canonical_locator", F.lit("UNRESOLVED")), T.squeezed("text")).orderBy(F.desc(priority), "source_type", "node_id")
    one = found.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    words = sorted({t for t in re.findall(r"\w+", question.casefold()) if len(t) > 2})
    overlap, vector = _overlap(T.evidence_tokens("text"), words), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("vector_score", F.lit(0.0))))
    specific = F.when(F.contains("canonical_locator", F.lit(":D")), 1.0).when(F.contains("canonical_locator", F.lit(":K")), 0.75).otherwise(0.5)
    score = 0.35 * F.greatest(vector, overlap) + 0.20 * overlap + 0.15 * F.col("relation_type").isNotNull().cast("double") + 0.10 * F.least(F.lit(1.0), F.size("roles") / 4) + 0.10 * specific + 0.10 * F.col("exact_provenance").cast("double")
    ranked = one.withColumn("rank_score", F.round(score, 6)).orderBy(F.desc("rank_score"), "graph_distance", F.coalesce("canonical_locator", F.lit("~")), "node_id")
    return ranked.limit(limit) if limit else ranked


def gate(ranked: DataFrame, relevance: DataFrame, keep: float = 0.45) -> DataFrame:
    """Candidates whose relevance (node_id, relevance) is enough, or the most relevant one."""
    r = ranked.join(relevance, "node_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    best = F.row_number().over(Window.orderBy(F.desc("relevance"), F.desc("rank_score"), "node_id"))  # over the candidates of one question
    return r.withColumn("__best", best).where((F.col("relevance") >= keep) | (F.col("__best") == 1)).withColumn("__any", F.max(F.col("relevance") >= keep).over(Window.partitionBy())).where(~F.col("__any") | (F.col("relevance") >= keep)).drop("__best", "__any")


def missing_facets(sufficiency: dict[str, float], enough: float = 0.70) -> list[str]:
    names = {"context_has_subject": "subject", "context_has_all_conditions": "conditions", "context_has_required_exception": "exception", "context_has_reference_target": "reference_target", "context_is_sufficient": "overall_sufficiency"}
    return [f for k, f in names.items() if sufficiency.get(k, 0.0) < enough]


# Context.
NO_EVIDENCE = "Không tìm thấy bằng chứng pháp lý đủ provenance để tạo ngữ cảnh."
CUT_MARK = "\n[Ngữ cảnh đã được giới hạn.]"


def within_budget(costs: Column, budget: int | Column) -> Column:
    """Places (from 0) of an array of costs that a greedy pass keeps: one that would not fit is left out, later ones still come."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).cast("long").alias("used"), none.alias("kept"))

    def step(s: Column, i: Column) -> Column:
        total = s["used"] + F.get(costs, i).cast("long")
        return F.when(total <= budget, F.struct(total.alias("used"), F.concat(s["kept"], F.array(i)).alias("kept"))).otherwise(s)

    return F.when(F.size(costs) > 0, F.aggregate(F.sequence(F.lit(0), F.size(costs) - 1), start, step, lambda s: s["kept"])).otherwise(none)


def rendered(found: DataFrame, law: str = "LD2024") -> Column:
    """The lines of a candidate, but for its number."""
    reference = F.when(F.col("relation_type").isNotNull(), F.concat(F.lit("Dẫn chiếu: "), F.coalesce("source_locator", F.lit("UNRESOLVED")), F.lit(" --"), "relation_type", F.lit("--> "), F.coalesce("target_locator", F.lit("UNRESOLVED"))))
    return F.concat_ws("\n", F.concat(F.lit("["), F.coalesce("canonical_locator", F.lit("UNRESOLVED")), F.lit("]")), F.concat(F.lit("Căn cứ: "), T.locator_text("canonical_locator", law)), F.concat(F.lit("Loại evidence: "), F.array_join("roles", ", ")), F.concat(F.lit("Nguồn truy hồi: "), "source_type"), reference, F.concat(F.lit("Nguyên văn: "), "text"))


def _in_budget(ranked: DataFrame, budget: int, law: str) -> DataFrame:
    """One row: the candidates of one question in order with their sections, what each costs, and the places of those that fit."""
    told = ranked.select(F.struct((-F.col("rank_score")).alias("r"), "graph_distance", "node_id", rendered(ranked, law).alias("section"), F.struct(*ranked.columns).alias("row")).alias("x"))
    rows = told.agg(F.array_sort(F.collect_list("x")).alias("rows"))
    head = 14  # characters of "Bằng chứng n "
    costs = F.transform("rows", lambda x: T.estimated_tokens(F.concat(F.lit(" " * head), x["section"])))
    return rows.withColumn("costs", costs).withColumn("kept", within_budget(F.col("costs"), budget))


def _numbered(section: Column, number: Column) -> Column:
    return F.concat(F.lit("Bằng chứng "), number.cast("string"), F.lit(" "), section)


def budgeted(ranked: DataFrame, budget: int = 10_000, law: str = "LD2024") -> DataFrame:
    """The candidates with `number`, their place in the context, and `section`, their text there, null where the budget leaves them out, and `estimated_tokens`."""
    each = _in_budget(ranked, budget, law).select(F.posexplode("rows").alias("i", "x"), "costs", "kept")
    number = F.nullif(F.array_position("kept", F.col("i")), F.lit(0).cast("long")).cast("int")
    return each.select("x.row.*", number.alias("number"), F.get("costs", F.col("i")).alias("estimated_tokens"), _numbered(F.col("x.section"), number).alias("section"))


def assemble(ranked: DataFrame, budget: int = 10_000, law: str = "LD2024") -> DataFrame:
    """One row: the context of the candidates of one question that fit the budget, and how many they are."""
    kept = _in_budget(ranked, budget, law)
    text = F.array_join(F.transform("kept", lambda i, n: _numbered(F.get("rows", i)["section"], n + 1)), "\n\n")
    used = F.aggregate(F.transform("kept", lambda i: F.get("costs", i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return kept.select(F.when(F.size("kept") > 0, text).otherwise(F.lit(NO_EVIDENCE)).alias("context"), F.size("rows").alias("candidate_count"), F.size("kept").alias("included_count"), used.alias("estimated_tokens"))


def citation(law_code: str = "law_code", article: str = "article_number", labels: str = "labels", number: str = "number", node: str = "node_id") -> Column:
    """Law, article, clause, point and node of a record, as far as it has them."""
    is_ = lambda t: F.coalesce(F.array_contains(labels, t), F.lit(False))
    art = F.coalesce(F.col(article).cast("string"), F.when(is_("ARTICLE"), F.col(number).cast("string")))
    return F.concat_ws(", ", F.col(law_code), F.concat(F.lit("Điều "), art), F.when(is_("CLAUSE"), F.concat(F.lit("khoản "), F.col(number).cast("string"))), F.when(is_("POINT"), F.concat(F.lit("điểm "), F.col(number).cast("string"))), F.concat(F.lit("node "), F.col(node)))


def bounded(text: Column, chars: int = 16_000) -> Column:
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, chars - len(CUT_MARK)))), F.lit(CUT_MARK)))


# Names of the modalities in a context.
MODALITY_NAMES = {"ALLOW": "được phép", "REQUIRE": "bắt buộc", "PROHIBIT": "bị cấm"}


#: Sections that a task puts in order.
SECTIONS = 20_000


def _joined(told: DataFrame) -> DataFrame:
    """One row: all sections (place, norm_id, s) in order. Runs of the order are joined by a task each, then their texts."""
    told = staged(told, "norm-sections")
    dealt = told.repartitionByRange(partitions(told.count(), SECTIONS), "place", "norm_id").withColumn("run", F.spark_partition_id())
    text = lambda first: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*first, "s"))), lambda x: x["s"]), "\n\n")
    runs = dealt.groupBy("run").agg(text(["place", "norm_id"]).alias("s"))
    return runs.agg(text(["run"]).alias("context"))


def assemble_norms(records: DataFrame, chars: int | None = 16_000, sized: bool = False) -> DataFrame:
    """One row: a section for each norm (norm_id, modality, role lists, evidence, citation), its citations once each.

    Without `chars` the context has all sections. Of a context beyond `chars` only the sections that can reach it are
    brought together. With `sized` a column `whole` tells how many characters there would be without the bound.
    """
    line = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    one = records.groupBy("norm_id").agg(*[F.first(c).alias(c) for c in ("modality", "subjects", "actions", "objects", "conditions", "exceptions", "consequences", "evidence")], F.array_join(F.sort_array(F.collect_set("citation")), "; ").alias("citations"), F.min("place").alias("place"))
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in MODALITY_NAMES.items() for x in kv])[F.col("modality")], F.col("modality"))
    unknown = lambda label, c: F.concat(F.lit(f"{label}: "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("không xác định")))
    section = F.concat_ws("\n", F.concat(F.lit("Quy tắc ("), "norm_id", F.lit("): "), name), unknown("Chủ thể", "subjects"), unknown("Hành động", "actions"), line("Đối tượng", "objects"), line("Điều kiện", "conditions"), line("Ngoại lệ", "exceptions"), line("Hệ quả", "consequences"), F.concat(F.lit("Nguyên văn: "), "evidence"), F.concat(F.lit("Căn cứ: "), "citations"))
    told = one.select("place", "norm_id", section.alias("s"))
    if chars is None:
        all_ = _joined(told)
    else:
        first = told.orderBy("place", "norm_id").limit(max(0, chars) // 3 + 2)  # a section and what parts it from the next are three characters or more
        all_ = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "norm_id", "s"))), lambda x: x["s"]), "\n\n").alias("context"))
    size = told.agg(F.coalesce(F.sum(F.length("s") + 2) - 2, F.lit(0)).alias("whole"))
    if sized:
        all_ = all_.join(F.broadcast(size))  # one row each
    context = F.when(F.col("context") == "", F.lit("Không tìm thấy quy phạm liên quan trong đồ thị pháp lý.")).otherwise(F.col("context"))
    return all_.select(*(["whole"] if sized else []), (context if chars is None else bounded(context, chars)).alias("context"))


def assemble_paths(paths: DataFrame, nodes: DataFrame, chars: int = 16_000) -> DataFrame:
    """One row: the texts of the physical nodes on the paths, each once."""
    on = paths.select(F.explode("nodes").alias("id")).distinct()
    told = nodes.join(on, "id", "left_semi").select("id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.col("title")).alias("said")).where("said is not null")
    section = F.concat(F.lit("Đoạn nguồn: "), "said", F.lit("\nCăn cứ: node "), "id")
    all_ = told.select("id", section.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: x["s"]), "\n\n").alias("context"))
    return all_.select(bounded(F.when(F.col("context") == "", F.lit("Không tìm thấy đoạn đồ thị liên quan trong đồ thị pháp lý.")).otherwise(F.col("context")), chars).alias("context"))


def hierarchy_context(records: DataFrame, included: DataFrame) -> DataFrame:
    """Parent and child pairs of which both are selected."""
    ids = included.select(F.col("node_id").alias("id")).distinct()
    pairs = records.where("parent_id is not null").select("parent_id", "id")
    return pairs.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").distinct()


def without_prefixes(paths: DataFrame) -> DataFrame:
    """Paths (steps array, score): of equal ones the best score, and none that another one goes on from."""
    best = paths.groupBy(F.array_join("steps", "\u0001").alias("key")).agg(F.first("steps").alias("steps"), F.max("score").alias("score"))
    heads = best.where(F.size("steps") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("steps") - 1), lambda n: F.array_join(F.slice("steps", 1, n), "\u0001"))).alias("key")).distinct()
    return best.join(heads, "key", "left_anti").drop("key")


# The pipeline.
def route_questions(questions: DataFrame, text: str = "question", probabilities: Column | None = None) -> DataFrame:
    """With signals, activated, uncertain and routing_source.

    probabilities: a map column of a decision service, null where it gave no answer. Without an answer the features of
    the rules and the cautious ones are on.
    """
    none = F.create_map().cast("map<string,double>")
    answer = probabilities if probabilities is not None else F.lit(None).cast("map<string,double>")
    told = questions.withColumn("signals", signals_of(text)).withColumn("__p", answer)
    rules = features_of(F.col("signals"))
    with_service, alone = policy(rules, F.coalesce("__p", none)), policy(rules, none, fallback=True)
    routed = told.withColumn("__r", F.when(F.col("__p").isNotNull(), with_service).otherwise(alone))
    source = F.when(F.col("__p").isNotNull(), "RULES_AND_SERVICE").otherwise("RULES_AND_FALLBACK")
    return routed.select(*[F.col(f"`{c}`") for c in questions.columns], "signals", "__r.activated", "__r.uncertain", source.alias("routing_source"))


def assess(ranked: DataFrame, judge=None, question: str = "", keep: float = 0.45, enough: float = 0.70) -> tuple[DataFrame, list[str], str]:
    """(candidates kept, missing facets, status) of the answerability gate.

    judge(question, ranked) gives (a DataFrame (node_id, relevance), a dict of sufficiency). Without it, or if it fails,
    all candidates stay at 0.5; without candidates nothing is answered.
    """
    if ranked.isEmpty():
        return ranked.withColumn("relevance", F.lit(0.0)), ["no_evidence"], "NO_EVIDENCE"
    if judge is None:
        return ranked.withColumn("relevance", F.lit(0.5)), [], "NOT_CONFIGURED"
    try:
        relevance, sufficiency = judge(question, ranked)
    except Exception:  # the service must never be the single point of failure
        return ranked.withColumn("relevance", F.lit(0.5)), [], "FAILED_FALLBACK_USED"
    return gate(ranked, relevance, keep), missing_facets(sufficiency, enough), "OK"


def above(locator: str | Column) -> Column:
    """The locator of the place above, or the locator itself at the top."""
    return F.regexp_replace(locator, "(.+):[^:]*$", "$1")


def forced_evidence(found: DataFrame, activated: list[str], paths: DataFrame, auxiliary: list[str]) -> DataFrame:
    """Candidates that stay whatever their rank: children of the first two anchors, and of reference targets, and ends of
    references from the anchors' articles or from auxiliary anchors."""
    anchors = [r["l"] for r in found.where("source_type = 'ANCHOR' and canonical_locator is not null").orderBy(F.desc("vector_score"), "node_id").limit(2).select(F.col("canonical_locator").alias("l")).collect()]
    article = lambda c: F.regexp_extract(c, r"^([^:]+:[^:]+)", 1)
    tops = sorted({x for a in anchors for x in (a, a.rsplit(":", 1)[0])})
    child, end = F.col("source_type") == "CHILD", F.col("source_type").isin("REFERENCE_SOURCE", "REFERENCE_TARGET")
    out = found.where(child & above("canonical_locator").isin(tops)) if "requires_all_children" in activated else found.limit(0)
    if "requires_reference_traversal" in activated:
        articles = sorted({":".join(a.split(":")[:2]) for a in anchors})
        targets = paths.select(F.col("target_locator").alias("__t")).where("__t is not null").distinct()
        out = out.unionByName(found.where(child).withColumn("__t", above("canonical_locator")).join(targets, "__t", "left_semi").drop("__t"))
        out = out.unionByName(found.where(end & article("source_locator").isin(articles)))
        from_them = paths.where(F.col("source_id").isin(auxiliary)).select("source_locator", "target_locator").distinct()
        out = out.unionByName(found.where(end).join(from_them, ["source_locator", "target_locator"], "left_semi").select(*found.columns))
    return out


def answer_context(question: str, nodes: DataFrame, vectors: DataFrame, query_vector: list[float], edges: DataFrame | None = None, norms: DataFrame | None = None, k: int = 5, limit: int = 12, law: str = "LD2024", decide=None, service=None, judge=None, law_range: tuple[int, int] = (26, 48), budget: int = 10_000) -> dict:
    """The evidence for a question: routed, retrieved, pruned, ranked, gated, expanded once where facets are missing, with answer paths.

    decide: gives (node_id, relevance) for ranked candidates. judge: gives that and the sufficiency of the facets, see
    `assess`. service(question, signals): probabilities of the features, see `route_questions`.
    Result: anchors, paths, candidates, evidence, included (the evidence as `budgeted`), context, hierarchy of what the context
    has (DataFrames), and route, answer_paths, missing, expansions.
    """
    spark = nodes.sparkSession
    docs = staged(nodes.withColumn("tokens", T.lexical_tokens(F.concat_ws(" ", "title", "text"))).where(F.size("tokens") > 0).withColumnRenamed("id", "node_id").select("node_id", "tokens"), "lexical")
    asked = spark.createDataFrame([(question,)], "question string")
    if service:
        try:
            answer = service(question, asked.select(signals_of("question").alias("s")).first()["s"])
            asked = asked.withColumn("__answer", F.create_map(*[F.lit(x) for kv in answer.items() for x in (kv[0], float(kv[1]))]))
        except Exception:  # as without a service
            answer = None
    route = route_questions(asked, probabilities=F.col("__answer") if "__answer" in asked.columns else None).first()
    on = set(route["activated"]) | set(route["uncertain"])
    tokens = [t for t in re.findall(r"[a-z0-9]+", folded(question)) if len(t) > 1 and t not in T.LEXICAL_STOPWORDS]
    lexical = bm25(docs, tokens, max(k, 10), article_boost(question))
    found = staged(merged(lexical.select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(k), vector_top(vectors, query_vector, k), k), "anchors")
    anchors = found.join(nodes.withColumnRenamed("id", "node_id"), "node_id")
    ids = [r["node_id"] for r in found.orderBy("place").collect()]  # k rows
    auxiliary = [r["node_id"] for r in lexical.orderBy(F.desc("score"), "node_id").limit(10).collect()] if "requires_reference_traversal" in on else []
    path_ids = list(dict.fromkeys(ids + auxiliary))
    locators = sorted({r["l"] for r in anchors.select(T.locator_of("node_id", law).alias("l")).collect() if r["l"]})
    references = staged(reference_edges(nodes, law, law_range), "references")

    def walked(hops: int) -> DataFrame:
        return staged(typed_paths(nodes, references, path_ids, hops, limit * 12), "typed-paths")

    def up() -> DataFrame:
        return parents(nodes, ids, limit * 2)

    def down(paths: DataFrame, above_: DataFrame | None) -> DataFrame:
        own = [] if above_ is None else [r["id"] for r in above_.where(F.col("type").isin("ARTICLE", "CLAUSE")).select("id").collect()]  # 2 * limit rows
        far = [r["target_id"] for r in paths.where(~F.col("target_id").startswith("external:")).select("target_id").distinct().collect()]  # 12 * limit rows
        return below(nodes, list(dict.fromkeys([*ids, *own, *far])), 2, limit * 6).withColumn("parent_locator", T.locator_of("parent_id", law)).withColumnRenamed("id", "node_id")

    all_paths = walked(2 if "requires_multi_hop" in on else 1)
    paths = prune_paths(question, all_paths, locators)
    sources: dict[str, DataFrame] = {"ANCHOR": anchors, "PHYSICAL_FALLBACK": physical(nodes, ids)}
    if on & {"requires_parent_context", "requires_subject_resolution", "requires_all_children"}:
        sources["PARENT"] = up()
    kids = down(all_paths, sources.get("PARENT")) if on & {"requires_all_children", "requires_reference_traversal"} else None

    def chosen(kids: DataFrame, paths: DataFrame) -> DataFrame:
        relevant = sorted({*locators, *(r["target_locator"] for r in paths.collect() if r["target_locator"])})  # a few paths
        return select_children(question, kids, relevant, "requires_all_children" in on).drop("score")

    if kids is not None:
        sources["CHILD"] = chosen(kids, paths)
    if "requires_exception" in on:
        sources["EXCEPTION"] = exceptions(nodes, ids, limit * 3)
    if edges is not None and norms is not None:
        sources["NORM"] = norms_of(nodes, edges, norms, ids).join(nodes.select(F.col("id").alias("source_id"), "text"), "source_id").withColumn("node_id", F.col("source_id"))

    def ranked_now() -> tuple[DataFrame, DataFrame]:
        every = staged(collect(sources, paths, law), "candidates")
        return every, staged(rank(question, every, limit), "ranked")

    every, ranked = ranked_now()
    kept, missing, status = assess(ranked, judge, question)
    expansions: list[str] = []
    if status == "OK" and missing:
        short = set(missing)
        if short & {"subject", "overall_sufficiency"}:
            sources["PARENT"] = up()
            expansions.append("PARENT_CONTEXT")
        if short & {"conditions", "overall_sufficiency"}:
            kids = down(paths, sources.get("PARENT"))
            sources["CHILD"] = chosen(kids, paths)
            expansions.append("CHILDREN")
        if short & {"reference_target", "overall_sufficiency"}:
            all_paths = walked(2)
            paths = prune_paths(question, all_paths, locators)
            expansions.append("REFERENCE_PATHS")
        if short & {"exception", "overall_sufficiency"}:
            sources["EXCEPTION"] = exceptions(nodes, ids, limit * 3)
            expansions.append("EXCEPTION_CONTEXT")
        every, ranked = ranked_now()
        kept, missing, status = assess(ranked, judge, question)
    if decide and judge is None:
        kept = gate(ranked, decide(question, ranked))
    liked = [r["canonical_locator"] for r in kept.select("canonical_locator").distinct().collect() if r["canonical_locator"]]  # `limit` rows
    below_ = (kids if kids is not None else down(all_paths, None)).withColumn("locator", T.locator_of("node_id", law)).select("parent_locator", "locator", "text")
    from .answers import answer_paths  # which takes the phrases of questions from here

    one = lambda df: df.withColumn("question_id", F.lit(0))
    numbered = lambda df: one(df).withColumn("place", F.monotonically_increasing_id())
    texts = staged(numbered(all_paths.select("source_locator", "relation_type", F.when(F.col("target_id").startswith("external:"), F.col("target_id")).otherwise(F.col("target_locator")).alias("target_locator"), "source_text", "target_text")), "answer-edges")
    told = staged(numbered(anchors.select(T.locator_of("node_id", law).alias("locator"), F.coalesce("text", "title").alias("text"))), "answer-anchors")
    best = spark.createDataFrame([(0, x) for x in liked], "question_id int, locator string")
    asked_one = spark.createDataFrame([(0, question, "requires_reference_traversal" in on)], "question_id int, question string, traversal boolean")
    found_paths, _ = answer_paths(asked_one, told, texts, staged(numbered(below_), "answer-children"), best)
    answers = [{"score": r["score"], "steps": [tuple(x) for x in r["steps"]]} for r in found_paths.orderBy("place").collect()]  # six paths
    on_paths = sorted({x for p in answers for s in p["steps"] for x in (s[0], s[2])})
    more = forced_evidence(every, sorted(on), paths, auxiliary)
    proof = collect({"CHILD": kids} if kids is not None else {"ANCHOR": anchors.limit(0)}, all_paths, law).where(F.col("canonical_locator").isin(on_paths))
    extra = more.unionByName(proof)
    have = kept.select(F.coalesce("canonical_locator", F.lit("")).alias("__l"), F.col("text").alias("__t")).distinct()
    new = extra.withColumns({"__l": F.coalesce("canonical_locator", F.lit("")), "__t": F.col("text")}).join(have, ["__l", "__t"], "left_anti").drop("__l", "__t")
    late = rank(question, new, None).withColumn("rank_score", F.col("rank_score") - 10)  # after the evidence that the gate has kept
    selected = staged(kept.select(*late.columns).unionByName(late), "evidence")
    included = staged(budgeted(selected, budget, law), "included")
    return {
        "route": route.asDict(), "anchors": found, "paths": paths, "candidates": ranked, "evidence": selected, "included": included, "context": assemble(selected, budget, law), "answer_paths": answers,
        "missing": missing, "gate": status, "expansions": expansions, "hierarchy": hierarchy_context(nodes, included.where("number is not null")),
    }


#: Walks that a task takes on by a step.
WALKS = 50_000


def rebuilt_paths(references: DataFrame, included: DataFrame, steps: int = 5) -> DataFrame:
    """(start, places, n): walks of up to `steps` selected references, no place twice, that cannot go on.

    references: (source_locator, target_locator); included: the places (column locator) that are selected. One join a step.
    """
    good = references.select("source_locator", "target_locator").distinct()
    for end in ("source_locator", "target_locator"):
        good = good.join(included.select(F.col("locator").alias(end)).distinct(), end, "left_semi")
    edge = staged(good.select(F.col("source_locator").alias("at"), F.col("target_locator").alias("to")), "path-edges")
    n_parts = partitions(edge.count(), WALKS)
    front = edge.join(edge.select(F.col("to").alias("at")).distinct(), "at", "left_anti").select(F.col("at").alias("start"), F.array("at", "to").alias("places"), F.col("to").alias("at"))
    out = None
    for n in range(1, steps + 1):
        onward = front.repartition(n_parts, "at").join(edge, "at").where(~F.array_contains("places", F.col("to"))) if n < steps else None
        ended = front if onward is None else front.join(onward.select("places").distinct(), "places", "left_anti")
        done = ended.select("start", "places", F.lit(n).alias("n"))
        out = done if out is None else out.unionByName(done)
        if onward is not None:
            front = onward.select("start", F.concat("places", F.array("to")).alias("places"), F.col("to").alias("at"))
    return out
