"""References in a text to nodes of the physical graph: hints, explicit places, and "this clause" and the like.

nodes: (id, parent_id, label, number, law_code); references: (ref_id, source_node_id, text, and, if there are any, scope
and the hint's fields hint_article, hint_clause, hint_section, hint_chapter). Numbers are compared without regard to
case. A place that is not unique resolves to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import ancestors

# Words that name an act, the own act, and words of a citation that are no title.
ACTS = ["luat ", "nghi dinh ", "thong tu ", "bo luat "]
OWN_ACTS = ["luat nay", "nghi dinh nay", "thong tu nay", "bo luat nay"]
NO_TITLE = ["dieu", "khoan", "muc", "chuong", "luat", "nghi", "dinh", "thong", "tu", "bo", "nay", "cua", "ve"]
# Levels that a text calls its own, in the order in which they are looked for.
OWN_LEVELS = [("khoản này", "CLAUSE"), ("điều này", "ARTICLE"), ("mục này", "SECTION"), ("chương này", "CHAPTER")]
INTERNAL_SCOPES = ["SAME_ARTICLE", "SAME_DOCUMENT"]
CLAUSE_OF_ARTICLE = r"khoản\s+(\d+)\s+điều\s+(\d+)"
SECTION_OF_CHAPTER = r"mục\s+(\d+)\s+chương\s+([0-9ivxlcdm]+)"


def is_local(text: str, law_code: Column, title_tokens: Column) -> Column:
    """Whether a citation stays in its own law.

    Codes that are cited must all be the law's. Without any, it does if it names no act, or its own one, or an act whose
    words are among those of the law's title.
    """
    folded = T.fold(text)
    codes = F.regexp_extract_all(folded, F.lit(r"\b(\d+/\d{4}/[a-z0-9]+)\b"))
    names = _says(folded, ACTS) & ~_says(folded, OWN_ACTS)
    words = F.filter(F.array_except(F.split(folded, "[^a-z0-9]+"), F.array(*map(F.lit, NO_TITLE))), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    return (
        F.when(F.size(codes) > 0, law_code.isNotNull() & (F.size(F.array_except(codes, F.array(T.fold(law_code)))) == 0))
        .when(~names, F.lit(True))
        .otherwise(F.coalesce(F.arrays_overlap(words, title_tokens), F.lit(False)))
    )


def _says(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def unique_places(nodes: DataFrame) -> DataFrame:
    """(law_code, label, number, target) of places that just one node has; a null law code matches no other."""
    key = ["law_code", "label", "number"]
    one = _numbered(nodes).groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("target"))
    return one.where("n = 1").drop("n")


def children_by_number(nodes: DataFrame) -> DataFrame:
    """(parent_id, label, number, target, n): the first child of a number below a node, and how many there are."""
    return _numbered(nodes).where("parent_id is not null").groupBy("parent_id", "label", "number").agg(F.min("id").alias("target"), F.count("*").alias("n"))


def _numbered(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "parent_id", "label", F.lower(F.col("number").cast("string")).alias("number"), "law_code").where("number is not null")


def _pairs(text: Column, pattern: str, label: str, above: str) -> Column:
    """The places that a compound names, as structs."""
    inner, outer = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(inner.alias("a"), outer.alias("b")), lambda x: F.struct(F.lit(label).alias("label"), x["a"].alias("number"), F.lit(above).alias("up_label"), x["b"].alias("up_number")))


def _single(text: Column, pattern: str, label: str) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(label).alias("label"), n.alias("number"), none.alias("up_label"), none.alias("up_number")))


def named_places(references: DataFrame) -> DataFrame:
    """(ref_id, law_code, place, label, number, up_label, up_number): the places that texts name, in order.

    Compounds come first (clause of an article, section of a chapter), then articles and chapters outside of them.
    """
    t = F.lower("text")
    rest = F.regexp_replace(F.regexp_replace(t, CLAUSE_OF_ARTICLE, " ; "), SECTION_OF_CHAPTER, " ; ")
    places = F.concat(_pairs(t, CLAUSE_OF_ARTICLE, "CLAUSE", "ARTICLE"), _pairs(t, SECTION_OF_CHAPTER, "SECTION", "CHAPTER"), _single(rest, r"điều\s+(\d+)", "ARTICLE"), _single(rest, r"chương\s+([0-9ivxlcdm]+)", "CHAPTER"))
    return references.select("ref_id", "law_code", F.posexplode(places).alias("place", "p")).select("ref_id", "law_code", "place", "p.*")


def by_text(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, targets): places named in local citations (references with law_code and title_tokens)."""
    named = named_places(references.where(is_local("text", F.col("law_code"), F.col("title_tokens"))))
    unique = unique_places(nodes)
    direct = named.where("up_label is null").join(unique, ["law_code", "label", "number"]).select("ref_id", "place", "target")
    above = unique.select("law_code", F.col("label").alias("up_label"), F.col("number").alias("up_number"), F.col("target").alias("parent_id"))
    nested = named.where("up_label is not null").join(above, ["law_code", "up_label", "up_number"]).join(children_by_number(nodes).where("n = 1"), ["parent_id", "label", "number"]).select("ref_id", "place", "target")
    return _in_order(direct.unionByName(nested))


def _in_order(found: DataFrame) -> DataFrame:
    """(ref_id, place, target) to (ref_id, targets): each target once, by its first place."""
    first = found.groupBy("ref_id", "target").agg(F.min("place").alias("place"))
    return first.groupBy("ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("targets"))


def own_levels(nodes: DataFrame) -> DataFrame:
    """(id, label, ancestor): the nearest node of each label at or above a node."""
    self_ = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    labels = nodes.select(F.col("id").alias("ancestor"), "label")
    return self_.unionByName(ancestors(nodes)).join(labels, "ancestor").groupBy("id", "label").agg(F.min_by("ancestor", "distance").alias("ancestor"))


def by_self(references: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(ref_id, targets): "khoản 2 điều này", "khoản này", "điều này", "mục 1 chương này" and the like, from the source on."""
    t = F.lower("text")
    number = F.coalesce(F.nullif(F.regexp_extract(t, r"khoản\s+(\d+)\s+điều\s+này", 1), F.lit("")), F.when(~_says(t, ["khoản này", "điều này"]), F.nullif(F.regexp_extract(t, r"mục\s+(\d+)\s+chương\s+này", 1), F.lit(""))))
    in_article = F.regexp_extract(t, r"khoản\s+(\d+)\s+điều\s+này", 1) != ""
    label = F.when(in_article, "ARTICLE").when(number.isNotNull(), "CHAPTER")
    for words, level in OWN_LEVELS:
        label = label.when(F.contains(t, F.lit(words)), level)
    r = references.select("ref_id", F.col("source_node_id").alias("id"), number.alias("number"), label.alias("label"), F.when(in_article, "CLAUSE").otherwise("SECTION").alias("child")).where("label is not null")
    r = r.join(closure, ["id", "label"])
    whole = r.where("number is null").select("ref_id", F.lit(0).alias("place"), F.col("ancestor").alias("target"))
    kids = _numbered(nodes).select(F.col("parent_id").alias("ancestor"), F.col("label").alias("child"), "number", F.col("id").alias("target"))
    part = r.where("number is not null").join(kids, ["ancestor", "child", "number"]).select("ref_id", F.lit(0).alias("place"), "target")
    return _in_order(whole.unionByName(part))


def by_hint(references: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(ref_id, targets): a clause of the hinted article if it is the only one, else the articles; else a section of the hinted chapter."""
    hint = lambda c: F.nullif(F.trim(F.coalesce(F.col(f"hint_{c}").cast("string"), F.lit(""))), F.lit(""))
    r = references.select("ref_id", F.col("source_node_id").alias("id"), "law_code", *[hint(c).alias(c) for c in ("article", "clause", "section", "chapter")])
    numbered = _numbered(nodes)
    same = lambda c, label: r.where(F.lower(c) == "same").join(closure.where(F.col("label") == label), "id").select("ref_id", F.col("ancestor").alias("top"))
    at = lambda c, label, rows: rows.join(numbered.where(F.col("label") == label).select(F.lower("number").alias("__n"), F.col("law_code").alias("__l"), F.col("id").alias("top")), (F.lower(c) == F.col("__n")) & (F.col("law_code").isNull() | (F.col("law_code") == F.col("__l")))).select("ref_id", "top")
    articles = same("article", "ARTICLE").unionByName(at("article", "ARTICLE", r.where(F.col("article").rlike(r"^\d+$")))).distinct()
    chapters = same("chapter", "CHAPTER").unionByName(at("chapter", "CHAPTER", r.where("chapter is not null and lower(chapter) <> 'same'"))).distinct()

    def only_child(tops: DataFrame, c: str, label: str) -> DataFrame:
        wanted = r.where(F.col(c).rlike(r"^\d+$")).select("ref_id", F.col(c).alias("number"))
        kids = numbered.where(F.col("label") == label).select(F.col("parent_id").alias("top"), "number", F.col("id").alias("target"))
        found = tops.join(wanted, "ref_id").join(kids, ["top", "number"]).groupBy("ref_id").agg(F.collect_set("target").alias("targets"))
        return found.where(F.size("targets") == 1)

    clauses = only_child(articles, "clause", "CLAUSE")
    no_clause = r.where(~F.coalesce(F.col("clause").rlike(r"^\d+$"), F.lit(False)))
    whole = articles.join(no_clause, "ref_id", "left_semi").groupBy("ref_id").agg(F.sort_array(F.collect_set("top")).alias("targets"))
    no_article = no_clause.join(articles, "ref_id", "left_anti")
    sections = only_child(chapters.join(no_article, "ref_id", "left_semi"), "section", "SECTION")
    return clauses.unionByName(whole).unionByName(sections)


def resolve(references: DataFrame, nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """(ref_id, targets, status): the hint first, then the places the text names, then what it calls its own.

    titles: (law_code, title_tokens) of the laws. scope: null, one of INTERNAL_SCOPES, EXTERNAL, AMBIGUOUS or another;
    only references without scope or with an internal one are tried. References from no node resolve to nothing.
    """
    hints = [c for c in ("hint_article", "hint_clause", "hint_section", "hint_chapter") if c not in references.columns]
    r = references.withColumns({c: F.lit(None).cast("string") for c in hints})
    scope = F.upper(F.trim(F.coalesce(F.col("scope") if "scope" in r.columns else F.lit(None), F.lit("")))).alias("scope")
    r = r.select("ref_id", "source_node_id", "text", scope, "hint_article", "hint_clause", "hint_section", "hint_chapter")
    known = r.where((F.col("scope") == "") | F.col("scope").isin(INTERNAL_SCOPES))
    known = known.join(nodes.select(F.col("id").alias("source_node_id"), "law_code"), "source_node_id").join(titles, "law_code", "left")
    closure = own_levels(nodes)
    tried = [f.withColumnRenamed("targets", f"by_{i}") for i, f in enumerate((by_hint(known, nodes, closure), by_text(known, nodes), by_self(known, nodes, closure)))]
    out = r
    for f in tried:
        out = out.join(f, "ref_id", "left")
    targets = F.coalesce("by_0", "by_1", "by_2", F.array().cast("array<string>"))
    status = (
        F.when(F.size(targets) > 0, "RESOLVED")
        .when(F.col("scope") == "EXTERNAL", "OUT_OF_SCOPE")
        .when(F.col("scope") == "AMBIGUOUS", "AMBIGUOUS")
        .when((F.col("scope") != "") & ~F.col("scope").isin(INTERNAL_SCOPES), "NOT_ATTEMPTED")
        .otherwise("TARGET_NOT_FOUND")
    )
    return out.select("ref_id", targets.alias("targets"), status.alias("status"))
