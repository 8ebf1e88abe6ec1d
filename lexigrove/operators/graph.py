"""Edges of the physical graph, property-graph rows, keys and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import partitions, staged

#: Nodes whose contexts a task makes.
CONTEXTS = 50_000


def belong_to(nodes: DataFrame) -> DataFrame:
    """Child to parent, for nodes with a parent; `implicit` is carried if the nodes have it."""
    implicit = F.col("implicit_parent") if "implicit_parent" in nodes.columns else F.lit(False)
    return nodes.where("parent_id is not null").select(F.col("id").alias("source"), F.col("parent_id").alias("target"), F.lit("BELONG_TO").alias("type"), implicit.alias("implicit"))


def sequential(nodes: DataFrame) -> DataFrame:
    """NEXT and PREVIOUS between siblings of one type, in the order of the text; roots have no siblings."""
    order = Window.partitionBy("parent_id", "type").orderBy("start_idx", "id")
    after = nodes.where("parent_id is not null").withColumn("next", F.lead("id").over(order)).where("next is not null")
    forward = after.select(F.col("id").alias("source"), F.col("next").alias("target"), F.lit("NEXT").alias("type"))
    return forward.unionByName(after.select(F.col("next").alias("source"), F.col("id").alias("target"), F.lit("PREVIOUS").alias("type")))


def edges(nodes: DataFrame) -> DataFrame:
    return belong_to(nodes).drop("implicit").unionByName(sequential(nodes))


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Parsed nodes as property-graph rows."""
    own = [c for c in nodes.columns if c not in ("id", "type")]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in own]), lambda x: x["value"].isNotNull())
    return nodes.select("id", F.lit("PHYSICAL").alias("node_kind"), F.array(F.lit("LegalNode"), F.col("type")).alias("labels"), F.map_from_entries(pairs).alias("properties"), F.array(F.lit("M4")).alias("provenance"))


def semantic_nodes(entities: DataFrame) -> DataFrame:
    """Entities (id, ontology_class, fusion_kind, properties) as property-graph rows."""
    label = F.when(F.col("fusion_kind") == "REFERENCE", F.array(F.lit("SemanticEntity"), F.lit("Reference"), F.col("ontology_class"))).otherwise(F.array(F.lit("SemanticEntity"), F.col("ontology_class")))
    return entities.select("id", F.lit("SEMANTIC").alias("node_kind"), label.alias("labels"), "properties", F.array(F.lit("M7")).alias("provenance"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def confidence(signals: Column, source_weight: Column) -> Column:
    """Noisy-or of the signals that are there (0.5 if none), times the weight of the source, in [0, 1], to four places."""
    present = F.filter(signals, lambda x: x.isNotNull())
    joint = F.when(F.size(present) > 0, 1 - product(F.transform(present, lambda x: 1 - clamp(x)))).otherwise(F.lit(0.5))
    return F.round(clamp(joint * F.coalesce(source_weight, F.lit(1.0))), 4)


def semantic_edges(relations: DataFrame) -> DataFrame:
    """Relations (source, target, relation_type, source_node_ids, signals?, source_weight?) as edges with weight and confidence."""
    e = relations.select("source", "target", F.col("relation_type").alias("type"), F.size("source_node_ids").alias("weight"), F.array(F.lit("M7")).alias("provenance"), *[c for c in ("signals", "source_weight") if c in relations.columns])
    if "signals" in relations.columns:
        e = e.withColumn("confidence", confidence(F.col("signals"), F.col("source_weight") if "source_weight" in relations.columns else F.lit(1.0))).drop("signals", "source_weight")
    return e


def mentions(pairs: DataFrame) -> DataFrame:
    """Physical node to entity, once each."""
    return pairs.select(F.col("node_id").alias("source"), F.col("entity_id").alias("target")).distinct().withColumns({"type": F.lit("MENTIONS"), "confidence": F.lit(1.0)})


def resolves_to(references: DataFrame) -> DataFrame:
    """Rows (reference_id, target_ids) to edges."""
    return references.select(F.col("reference_id").alias("source"), F.explode("target_ids").alias("target"), F.lit("RESOLVES_TO").alias("type")).distinct()


def edge_key(source: str = "source", target: str = "target", type_: str = "type", qualifier: Column | None = None) -> Column:
    """A stable identity of an edge: SHA-256 over a JSON array, so that no separator can be forged."""
    q = qualifier if qualifier is not None else F.lit("")
    return F.sha2(F.to_json(F.array(F.col(source).cast("string"), F.col(target).cast("string"), F.col(type_).cast("string"), F.coalesce(q, F.lit("")))), 256)


def search_text(nodes: DataFrame) -> DataFrame:
    """With search_text: id, kind, labels and the properties in the order of their names."""
    entries = F.array_sort(F.map_entries("properties"))
    return nodes.withColumn("search_text", F.concat_ws(" ", "id", "node_kind", F.array_join("labels", " "), F.to_json(F.map_from_entries(entries))))


def attach_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes (column id) with their vectors (node_id, embedding). The two sets of ids must be equal."""
    both = nodes.select("id").join(vectors.select(F.col("node_id").alias("id"), F.lit(1).alias("has")), "id", "full_outer").join(nodes.select("id", F.lit(1).alias("is_node")), "id", "left")
    odd = both.where("has is null or is_node is null").select("id", F.when(F.col("has").isNull(), "no vector").otherwise("no node").alias("lacks"))
    if not odd.isEmpty():
        raise ValueError(f"vectors and nodes differ: {[tuple(r) for r in odd.limit(10).collect()]}")
    return nodes.join(vectors.withColumnRenamed("node_id", "id"), "id")


def ancestors(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """Rows (id, ancestor, distance) of all levels, or up to `levels` steps: a join for each.

    Without `levels` the steps are staged until one is empty. Parents that go in a circle are told once each, at their
    smallest distance: whether a way has come back is looked at after 8 steps, after 16 and so on.
    """
    up = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"))
    if levels is None:
        return _all_ancestors(staged(up, "ancestors-up"))
    step, out = up.withColumn("distance", F.lit(1)), None
    for d in range(1, levels + 1):
        out = step if out is None else out.unionByName(step)
        if d < levels:
            step = step.join(up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(d + 1).alias("distance"))
    return out


def _all_ancestors(up: DataFrame) -> DataFrame:
    above = up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
    step, d, circles = up.withColumn("distance", F.lit(1)), 1, False
    out = step
    while True:
        d += 1
        step = staged(step.join(above, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(d).alias("distance")), "ancestors")
        if d >= 8 and d & (d - 1) == 0 and not step.join(out, ["id", "ancestor"], "left_semi").isEmpty():
            circles, step = True, staged(step.join(out, ["id", "ancestor"], "left_anti"), "ancestors")
        if step.isEmpty():
            return out.groupBy("id", "ancestor").agg(F.min("distance").alias("distance")) if circles else out
        out = out.unionByName(step)


def nearest_ancestor(nodes: DataFrame, label: str, levels: int | None = None) -> DataFrame:
    """(id, ancestor): the node itself or the nearest above it of a type."""
    self_ = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    closure = self_.unionByName(ancestors(nodes, levels))
    kinds = nodes.select(F.col("id").alias("ancestor"), "type").where(F.col("type") == label)
    return closure.join(kinds, "ancestor").groupBy("id").agg(F.min_by("ancestor", "distance").alias("ancestor"))


def context_path(nodes: DataFrame, stop: str = "ARTICLE", levels: int | None = None) -> DataFrame:
    """(id, context): lines `- TYPE: title - text` of the ancestors up to the first of type `stop`, outermost first."""
    told = nodes.select(F.col("id").alias("ancestor"), "type", F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.concat_ws(" - ", "title", "text")).alias("line"))
    n = partitions(nodes.count(), CONTEXTS)
    chain = ancestors(nodes, levels).join(told, "ancestor").repartition(n, "id")
    above = F.sort_array(F.collect_list(F.struct("distance", F.coalesce(F.col("type") == stop, F.lit(False)).alias("stops"), "line")), asc=False)
    last = F.array_min(F.transform(F.filter("above", lambda x: x["stops"]), lambda x: x["distance"]))
    kept = F.filter("above", lambda x: F.col("last").isNull() | (x["distance"] <= F.col("last")))
    lines = chain.groupBy("id").agg(above.alias("above")).withColumn("last", last).select("id", F.transform(kept, lambda x: x["line"]).alias("lines"))
    return nodes.select("id").repartition(n, "id").join(lines, "id", "left").select("id", F.coalesce(F.array_join("lines", "\n"), F.lit("")).alias("context"))


def build(nodes: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row of metadata) of the physical graph."""
    e = staged(edges(nodes), "edges")
    n = graph_nodes(nodes)
    meta = n.agg(F.count("*").alias("total_nodes")).join(F.broadcast(e.agg(F.count("*").alias("total_edges"))))  # one row each
    return n, e, meta.select(F.lit("1.0").alias("schema_version"), F.lit(document_id).alias("document_id"), "total_nodes", "total_edges")
