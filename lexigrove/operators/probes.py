"""Questions that a finished graph must answer, and probes that must find nothing.

nodes: physical (id, type, parent_id, text, number); norms: (id, modality, source_node_ids); edges: (source, target, type);
terms: (id, canonical_text) of subjects, actions, conditions and exceptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import ancestors, nearest_ancestor


def _ends(edges: DataFrame, terms: DataFrame, type_: str, name: str) -> DataFrame:
    e = edges.where(F.col("type") == type_).select(F.col("source").alias("norm_id"), F.col("target").alias("id"))
    return e.join(terms.select("id", F.col("canonical_text").alias(name)), "id").select("norm_id", F.col("id").alias(f"{name}_id"), name)


def _naming(df: DataFrame, column: str, text: str | None) -> DataFrame:
    return df.where(F.contains(F.lower(column), F.lit(text.lower()))) if text else df


def statements(norms: DataFrame, edges: DataFrame, terms: DataFrame, subject: str | None = None, action: str | None = None, modality: str | None = None, condition: str | None = None) -> DataFrame:
    """(norm_id, modality, subject, action): what subjects may, must or must not do; any part may be asked for by its text."""
    n = norms.where(F.col("modality") == modality) if modality else norms
    out = n.select(F.col("id").alias("norm_id"), "modality").join(_naming(_ends(edges, terms, "HAS_SUBJECT", "subject"), "subject", subject), "norm_id").join(_naming(_ends(edges, terms, "HAS_ACTION", "action"), "action", action), "norm_id")
    if condition:
        out = out.join(_naming(_ends(edges, terms, "HAS_CONDITION", "condition"), "condition", condition), "norm_id", "left_semi")
    return out.select("norm_id", "modality", "subject", "action")


def parts_of_action(norms: DataFrame, edges: DataFrame, terms: DataFrame, action: str, within: str, part: str = "HAS_CONDITION") -> DataFrame:
    """Distinct texts of the conditions (or exceptions) of norms on an action that come from nodes whose id contains `within`."""
    here = norms.select(F.col("id").alias("norm_id"), F.explode("source_node_ids").alias("node")).where(F.contains("node", F.lit(within))).select("norm_id").distinct()
    named = _naming(_ends(edges, terms, "HAS_ACTION", "action"), "action", action).select("norm_id").distinct()
    return _ends(edges, terms, part, "part").join(here, "norm_id", "left_semi").join(named, "norm_id", "left_semi").select("part").distinct()


def references_of(edges: DataFrame, node_id: str) -> DataFrame:
    """Targets that the norms mentioned by a node refer to."""
    told = edges.where((F.col("type") == "MENTIONS") & (F.col("source") == node_id)).select(F.col("target").alias("source"))
    return edges.where("type = 'REFERENCE_TO'").join(told, "source", "left_semi").select("target").distinct()


def only_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """Actions of one set of statements that the other lacks, for comparing subjects."""
    return first.select("action").distinct().join(second.select("action").distinct(), "action", "left_anti")


def articles_of(norms: DataFrame, edges: DataFrame, terms: DataFrame, nodes: DataFrame, subject: str, action: str) -> DataFrame:
    """(modality, number, text): the nodes behind the norms of a subject on an action, with the number of their article."""
    found = statements(norms, edges, terms, subject, action).select("norm_id", "modality").distinct()
    behind = found.join(norms.select(F.col("id").alias("norm_id"), F.explode("source_node_ids").alias("id")), "norm_id")
    article = nearest_ancestor(nodes, "ARTICLE").join(nodes.select(F.col("id").alias("ancestor"), F.col("number")), "ancestor").select("id", "number")
    return behind.join(article, "id").join(nodes.select("id", "text"), "id").select("modality", "number", "text")


# Probes.
def broken_branches(nodes: DataFrame, root: str = "CHAPTER") -> DataFrame:
    """Clauses and points from which no chapter is reached."""
    tops = ancestors(nodes).join(nodes.where(F.col("type") == root).select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return nodes.where(F.col("type").isin("CLAUSE", "POINT")).join(tops.select("id").distinct(), "id", "left_anti").select("id", "type")


def not_grounded(nodes: DataFrame, dimension: int) -> DataFrame:
    """Nodes without text, or without a vector of the right length."""
    return nodes.where((F.trim(F.coalesce("text", F.lit(""))) == "") | F.col("embedding").isNull() | (F.size("embedding") != dimension)).select("id")


def ghost_pointers(norms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(norm id, node): sources of norms that are no node."""
    return norms.select("id", F.explode("source_node_ids").alias("node")).join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select("id", "node")


def unmentioned(terms: DataFrame, edges: DataFrame) -> DataFrame:
    return terms.join(edges.where("type = 'MENTIONS'").select(F.col("target").alias("id")), "id", "left_anti")


def without_action(norms: DataFrame, edges: DataFrame) -> DataFrame:
    return norms.join(edges.where("type = 'HAS_ACTION'").select(F.col("source").alias("id")), "id", "left_anti")


def collisions(norms: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, action, first, second): pairs of unconditional norms of different modality on the same subject and action."""
    free = norms.select("id", "modality").join(edges.where("type = 'HAS_CONDITION'").select(F.col("source").alias("id")), "id", "left_anti")
    of = lambda t, c: edges.where(F.col("type") == t).select(F.col("source").alias("id"), F.col("target").alias(c))
    each = free.join(of("HAS_SUBJECT", "subject"), "id").join(of("HAS_ACTION", "action"), "id")
    side = lambda p: each.select("subject", "action", F.col("id").alias(p), F.col("modality").alias(f"{p}_modality"))
    return side("first").join(side("second"), ["subject", "action"]).where("first < second and first_modality <> second_modality").select("subject", "action", "first", "second").distinct()


def collision_classes(norms: DataFrame, edges: DataFrame) -> DataFrame:
    """The collisions counted by class: (subject, action, first_modality, second_modality, n_first, n_second, n_pairs), no row a pair.

    A class is the unconditional norms of one modality on a subject and action; any two classes collide in all their
    pairs. Ids of norms are unique.
    """
    free = norms.select("id", "modality").join(edges.where("type = 'HAS_CONDITION'").select(F.col("source").alias("id")), "id", "left_anti")
    of = lambda t, c: edges.where(F.col("type") == t).select(F.col("source").alias("id"), F.col("target").alias(c)).distinct()
    each = free.join(of("HAS_SUBJECT", "subject"), "id").join(of("HAS_ACTION", "action"), "id")
    sizes = each.groupBy("subject", "action", "modality").agg(F.count("*").alias("n"))
    side = lambda p: sizes.select("subject", "action", F.col("modality").alias(f"{p}_modality"), F.col("n").alias(f"n_{p}"))
    return side("first").join(side("second"), ["subject", "action"]).where("first_modality < second_modality").withColumn("n_pairs", F.col("n_first") * F.col("n_second"))
