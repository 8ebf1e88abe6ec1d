"""Extractions to a canonical graph: filters, typing by rules, relations, gates, norms, references, integrity.

Entities are rows (node_id, pos, id, text, entity_type, evidence), relations (node_id, pos, source, relation_type, target,
source_status, evidence); `pos` is the place in the extraction, on which "the first wins" depends. Rule tables come
as small DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import staged

# Types, heads of subjects, vague texts, and what the types become.
ENTITY_TYPES = ["SUBJECT", "ACTION", "OBJECT", "CONDITION", "EXCEPTION", "REFERENCE", "PENALTY", "PERMISSION", "OBLIGATION"]
MODALITIES = ["ALLOW", "REQUIRE", "PROHIBIT"]
SEMANTIC_TYPES = {"SUBJECT": "LegalSubject", "ACTION": "LegalAction", "OBJECT": "LegalObject", "CONDITION": "Condition", "EXCEPTION": "Exception", "REFERENCE": "Reference", "PENALTY": "LegalConsequence"}
SUBJECT_HEADS = ["người ", "cá nhân ", "tổ chức ", "đại diện ", "người đại diện ", "cơ quan ", "nhà nước", "ủy ban ", "uỷ ban ", "bên "]
RELATION_TYPES = {"ALLOW": "ALLOW", "REQUIRE": "REQUIRE", "PROHIBIT": "PROHIBIT", "HAS_CONDITION": "HAS_CONDITION", "HAS_EXCEPTION": "HAS_EXCEPTION", "HAS_OBJECT": "HAS_OBJECT", "HAS_PENALTY": "HAS_CONSEQUENCE", "APPLY_TO": "HAS_OBJECT"}
MODIFIERS = {"HAS_SUBJECT": "LegalSubject", "HAS_ACTION": "LegalAction", "HAS_CONDITION": "Condition", "HAS_EXCEPTION": "Exception", "HAS_CONSEQUENCE": "LegalConsequence"}
REFERENCE_PATTERNS = [
    ("REF_RELATIVE_POINT_IN_CLAUSE", r"điểm\s+([a-zđ])\s+khoản\s+này", "SAME_ARTICLE", ("marker",)),
    ("REF_RELATIVE_CLAUSE_IN_ARTICLE", r"khoản\s+(\d+)\s+điều\s+này", "SAME_ARTICLE", ("number",)),
    ("REF_RELATIVE_THIS_CLAUSE", r"khoản\s+này", "SAME_ARTICLE", ()),
    ("REF_RELATIVE_THIS_ARTICLE", r"điều\s+này", "SAME_ARTICLE", ()),
    ("REF_RELATIVE_POINT_CLAUSE_ARTICLE", r"điểm\s+([a-zđ])\s+khoản\s+(\d+)\s+điều\s+này", "SAME_ARTICLE", ("marker", "clause_number")),
    ("REF_ABSOLUTE_ARTICLE", r"(?:điều|Điều)\s+(\d+)", "SAME_DOCUMENT", ("article_number",)),
    ("REF_ABSOLUTE_CLAUSE_IN_ARTICLE", r"khoản\s+(\d+)\s+(?:điều|Điều)\s+(\d+)", "SAME_DOCUMENT", ("clause_number", "article_number")),
    ("REF_ABSOLUTE_POINT_CLAUSE_ARTICLE", r"điểm\s+([a-zđ])\s+khoản\s+(\d+)\s+(?:điều|Điều)\s+(\d+)", "SAME_DOCUMENT", ("marker", "clause_number", "article_number")),
]


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _among(value: Column, values: list[str]) -> Column:
    """Whether a value is one of a few; false for null. Within array functions this takes a fraction of the time of `isin`."""
    return _map({v: True for v in values})[value].isNotNull()


def exploded(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extraction rows to entities and relations, with their places."""
    e = extractions.select("node_id", F.posexplode("entities").alias("pos", "e")).select("node_id", "pos", "e.*")
    r = extractions.select("node_id", F.posexplode("relations").alias("pos", "r")).select("node_id", "pos", "r.*")
    return e, r


def entity_reasons(entities: DataFrame) -> DataFrame:
    """With `reason`: why an entity is rejected, or null. An id counts as seen only from an accepted entity on."""
    id_, kind = F.trim(F.coalesce("id", F.lit(""))), F.upper(F.trim(F.coalesce("entity_type", F.lit(""))))
    own = F.when(id_ == "", "missing_id")
    later = F.when(T.is_placeholder("text"), "placeholder_text").when(~kind.isin(ENTITY_TYPES), "invalid_type").when(~T.is_valid_evidence("evidence"), "invalid_evidence")
    rows = entities.withColumns({"__own": own, "__later": later})
    ok = F.col("__own").isNull() & F.col("__later").isNull()
    first = F.min(F.when(ok, F.col("pos"))).over(Window.partitionBy("node_id", "id"))
    seen = first.isNotNull() & (F.col("pos") > first)
    return rows.withColumn("reason", F.coalesce("__own", F.when(seen, "duplicate_id"), "__later")).drop("__own", "__later")


def filter_entities(entities: DataFrame) -> DataFrame:
    return entity_reasons(entities).where("reason is null").drop("reason")


def _relation_reason(source: Column, known: Column, target_kind: Column, kind: Column, status: Column, evidence: Column) -> Column:
    no_source = F.coalesce(source, F.lit("")) == ""
    partial = _among(kind, MODALITIES) & (F.upper(F.coalesce(status, F.lit(""))) == "UNRESOLVED") & F.coalesce(target_kind == "ACTION", F.lit(False)) & evidence
    return (
        F.when(no_source & ~partial, "invalid_unresolved_source")
        .when(~no_source & ~known, "orphan_source")
        .when(target_kind.isNull(), "orphan_target")
        .when(kind == "", "missing_relation_type")
        .when(~evidence, "invalid_evidence")
    )


def relation_reasons(relations: DataFrame, accepted: DataFrame) -> DataFrame:
    """With `reason`. A relation without source is a partial norm: an unresolved modality on an action with evidence."""
    ends = accepted.select("node_id", "id", F.upper(F.trim("entity_type")).alias("kind"))
    rows = relations.join(ends.select("node_id", F.col("id").alias("source"), F.lit(True).alias("__s")), ["node_id", "source"], "left")
    rows = rows.join(ends.select("node_id", F.col("id").alias("target"), F.col("kind").alias("__t")), ["node_id", "target"], "left")
    kind = F.upper(F.trim(F.coalesce("relation_type", F.lit(""))))
    rows = rows.withColumn("__r", _relation_reason(F.col("source"), F.col("__s").isNotNull(), F.col("__t"), kind, F.col("source_status"), T.is_valid_evidence("evidence")))
    same = Window.partitionBy("node_id", F.coalesce("source", F.lit("")), kind, "target", T.quality_text("evidence"), F.col("__r").isNull()).orderBy("pos")
    return rows.withColumn("reason", F.coalesce("__r", F.when(F.row_number().over(same) > 1, "duplicate_relation"))).drop("__r", "__s", "__t")


def filter_relations(relations: DataFrame, accepted: DataFrame) -> DataFrame:
    return relation_reasons(relations, accepted).where("reason is null").drop("reason")


def node_reasons(extractions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(node_id, reason): nodes without id or extraction, or of which no entity is left; null for good ones."""
    left = accepted.groupBy("node_id").agg(F.count("*").alias("n"))
    reason = F.when(F.trim(F.coalesce("node_id", F.lit(""))) == "", "missing_node_id").when(F.col("entities").isNull() & F.col("relations").isNull(), "missing_extraction").when(F.coalesce("n", F.lit(0)) == 0, "empty_after_filter")
    return extractions.join(left, "node_id", "left").select("node_id", reason.alias("reason"))


def rejections(reasons: DataFrame) -> DataFrame:
    return reasons.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def has_subject_head(text: Column, squeezed: Column | None = None) -> Column:
    return (T.squeezed(text) if squeezed is None else squeezed).rlike("^(?:" + "|".join(SUBJECT_HEADS) + ")")


def match_rules(items: DataFrame, rules: DataFrame, text: str = "text", kind: str = "entity_type", key: tuple = ("node_id", "pos")) -> DataFrame:
    """Items with the first rule that fits: rules (rule_no, rule_id, m6_type, triggers, negative_triggers, subtype, concept_id, action, confidence, head_guard).

    Containment is no equi-join; rules are a stated small table (checked: under 10,000 rows) and meet only items of their
    type. Of the rules that fit, the one with the smallest number stays, by an aggregation per item.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("the rule table is too large to be sent to all tasks")
    typed = items.withColumns({"__text": T.squeezed(text), "__type": F.upper(F.col(kind))})
    both = typed.join(F.broadcast(rules.withColumnRenamed("m6_type", "__type")), "__type")
    hit = F.exists("triggers", lambda t: F.contains(F.col("__text"), t)) & ~F.exists("negative_triggers", lambda t: F.contains(F.col("__text"), t))
    guarded = F.coalesce(F.col("head_guard"), F.lit(False)) & (F.col("__type") == "SUBJECT") & has_subject_head(F.col(text))
    best = both.where(hit & ~guarded).groupBy(*key).agg(F.min_by(F.struct("rule_id", "subtype", "concept_id", "action", "confidence"), "rule_no").alias("rule"))
    return items.join(best, list(key), "left")


def _ruled(rule: Column, kind: Column) -> Column:
    """The status of a mention by the rule that fits, or null."""
    flagged = (rule["action"] == "FLAG") | (rule["confidence"] == "LOW")
    quarantined = flagged & (kind == "SUBJECT") & F.coalesce(F.contains(rule["subtype"], F.lit("Object")), F.lit(False))
    return F.when(rule.isNull(), "VALID").when(quarantined, "QUARANTINED").when(flagged, "UNRESOLVED").when(rule["subtype"].isNotNull(), "CORRECTED").otherwise("VALID")


def normalize_entities(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Accepted entities to mentions (mention_id, node_id, semantic_type, status, subtype, concept_id, rule_id, text, evidence).

    Permissions and obligations are no mentions. Ids count the mentions of a type within a node.
    """
    typed = entities.withColumn("semantic_type", _map(SEMANTIC_TYPES)[F.upper("entity_type")]).where("semantic_type is not null")
    n = F.row_number().over(Window.partitionBy("node_id", F.upper("entity_type")).orderBy("pos"))
    typed = typed.withColumn("mention_id", F.concat_ws("#", "node_id", F.upper("entity_type"), n.cast("string")))
    m = match_rules(typed, rules)
    status = _ruled(F.col("rule"), F.upper("entity_type"))
    known = status.isin("QUARANTINED", "CORRECTED")
    evidence = F.when(F.trim(F.coalesce("evidence", F.lit(""))) == "", F.col("text")).otherwise(F.col("evidence"))
    return m.select("mention_id", "node_id", "pos", F.col("id").alias("entity_id"), "semantic_type", status.alias("status"), F.when(known, F.col("rule.subtype")).alias("subtype"), F.when(known, F.col("rule.concept_id")).alias("concept_id"), F.col("rule.rule_id").alias("rule_id"), "text", evidence.alias("evidence"))


def type_paths(mentions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """With `type_hierarchy`: the path (array) of the subtype in a flattened taxonomy (subtype, path), else [type, subtype]."""
    short = F.when(F.col("subtype").isNull(), F.array("semantic_type")).otherwise(F.array("semantic_type", "subtype"))
    return mentions.join(taxonomy, "subtype", "left").withColumn("type_hierarchy", F.coalesce("path", short)).drop("path")


def flatten_taxonomy(tree: dict, above: tuple = ()) -> list[tuple[str, list[str]]]:
    """A nested dict of types to (subtype, path) rows."""
    return [x for k, below in tree.items() for x in ((k, [*above, k]), *(flatten_taxonomy(below, (*above, k)) if isinstance(below, dict) else ()))]


def normalize_relations(relations: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Accepted relations to (node_id, pos, source_id, target_id, relation_type, source_status, evidence) between mentions.

    Renamed types are renamed; references and unknown types go; so do relations on permissions and obligations, which
    only set the modality, and those whose target, or resolved source, is no mention.
    """
    ids = mentions.select("node_id", "entity_id", "mention_id")
    r = relations.withColumn("relation_type", _map(RELATION_TYPES)[F.upper("relation_type")]).where("relation_type is not null")
    r = r.join(ids.select("node_id", F.col("entity_id").alias("source"), F.col("mention_id").alias("source_id")), ["node_id", "source"], "left").join(ids.select("node_id", F.col("entity_id").alias("target"), F.col("mention_id").alias("target_id")), ["node_id", "target"], "left")
    status = F.upper(F.coalesce("source_status", F.lit("RESOLVED")))
    return r.where(F.col("target_id").isNotNull() & (F.col("source_id").isNotNull() | (status == "UNRESOLVED"))).select("node_id", "pos", "source_id", "target_id", "relation_type", status.alias("source_status"), "evidence")


def modality(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(node_id, modality): the last relation on a permission or obligation decides, else the first normative relation."""
    special = entities.where(F.upper("entity_type").isin("PERMISSION", "OBLIGATION")).select("node_id", F.col("id").alias("target"), F.when(F.upper("entity_type") == "PERMISSION", "ALLOW").otherwise("REQUIRE").alias("__by"))
    kind = F.upper("relation_type")
    r = relations.join(special, ["node_id", "target"], "left")
    plain = F.min_by(kind, F.when(kind.isin(MODALITIES), F.col("pos")))
    strong = F.max_by("__by", F.when(F.col("__by").isNotNull(), F.col("pos")))
    return r.groupBy("node_id").agg(strong.alias("s"), plain.alias("p")).select("node_id", F.coalesce("s", "p").alias("modality")).where("modality is not null")


def gate(mentions: DataFrame, relations: DataFrame, vague: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions without evidence are quarantined and vague ones unresolved; relations on quarantined ones, or structural ones without source, go.

    vague: texts, or a DataFrame with a column `text`, which is joined, for lists of any size.
    """
    unproven = F.trim(F.coalesce("evidence", F.lit(""))) == ""
    if isinstance(vague, DataFrame):
        known = vague.select(F.col("text").alias("__text")).distinct().withColumn("__vague", F.lit(True))
        told = mentions.withColumn("__text", T.squeezed("text")).join(known, "__text", "left")
        m = told.withColumn("status", F.when(unproven, "QUARANTINED").when(F.col("__vague"), "UNRESOLVED").otherwise(F.col("status"))).select(*mentions.columns)
    else:
        m = mentions.withColumn("status", F.when(unproven, "QUARANTINED").when(T.squeezed("text").isin(vague), "UNRESOLVED").otherwise(F.col("status")))
    bad = m.where("status = 'QUARANTINED'").select("mention_id")
    r = relations.where(F.col("source_id").isNotNull() | F.col("relation_type").isin(MODALITIES))
    for end in ("source_id", "target_id"):
        r = r.join(bad.withColumnRenamed("mention_id", end), end, "left_anti")
    return m, r


def denotes(mentions: DataFrame) -> DataFrame:
    return mentions.where("concept_id is not null").select(F.col("mention_id").alias("source"), F.col("concept_id").alias("target"), F.lit("DENOTES").alias("type"))


def concepts_used(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Concepts with mentions, with their number; ids that the registry lacks get a plain concept from their first mention."""
    n = mentions.where("concept_id is not null").groupBy("concept_id").agg(F.count("*").alias("mention_count"), F.min_by("text", F.struct("node_id", "pos")).alias("first_text"))
    return n.join(registry, "concept_id", "left").select("concept_id", F.coalesce("label", "first_text").alias("label"), "mention_count", F.col("label").isNull().alias("is_new"))


def build_norms(mentions: DataFrame, relations: DataFrame, modalities: DataFrame) -> DataFrame:
    """One norm a node that has a modality and is more than one plain statement, as rows of the schema NORM.

    It is, if a source is unresolved, or there is a condition, exception or consequence, or more than one subject.
    """
    def ids(kind):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("semantic_type") == kind, F.struct("pos", "mention_id")))), lambda x: x["mention_id"])

    kinds = {"subject_ids": "LegalSubject", "action_ids": "LegalAction", "object_ids": "LegalObject", "condition_ids": "Condition", "exception_ids": "Exception", "consequence_ids": "LegalConsequence"}
    usable = mentions.where("status <> 'QUARANTINED'")
    evidence = F.array_join(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence"))), lambda x: x["evidence"])), 1, 3), " | ")
    parts = usable.groupBy("node_id").agg(*[ids(k).alias(c) for c, k in kinds.items()], evidence.alias("evidence"))
    open_ = relations.groupBy("node_id").agg(F.max((F.col("source_status") == "UNRESOLVED").cast("int")).alias("unresolved"))
    n = parts.join(modalities, "node_id").join(open_, "node_id", "left")
    complex_ = (F.coalesce("unresolved", F.lit(0)) == 1) | (F.size("condition_ids") > 0) | (F.size("exception_ids") > 0) | (F.size("consequence_ids") > 0) | (F.size("subject_ids") > 1)
    group = F.when(F.size("condition_ids") > 0, F.array(F.struct(F.lit("G1").alias("group_id"), F.lit("AND").alias("operator"), F.col("condition_ids"), F.lit(False).alias("is_complex"))))
    status = F.when(F.size("subject_ids") > 0, "RESOLVED").otherwise("UNRESOLVED")
    return n.where(complex_).select(
        F.concat(F.col("node_id"), F.lit("#NORM#1")).alias("id"), "modality", *kinds, F.coalesce(group, F.array().cast("array<struct<group_id:string,operator:string,condition_ids:array<string>,is_complex:boolean>>")).alias("condition_groups"),
        status.alias("subject_status"), F.when(F.size("subject_ids") > 0, "COMPLETE").otherwise("PARTIAL").alias("norm_completeness"), F.col("node_id").alias("provenance_node_id"), "evidence", F.lit("NORM_BUILD").alias("rule_id"), F.lit("VALID").alias("status"),
    )


ROLES = {"HAS_SUBJECT": "subject_ids", "HAS_ACTION": "action_ids", "HAS_OBJECT": "object_ids", "HAS_CONDITION": "condition_ids", "HAS_EXCEPTION": "exception_ids", "HAS_CONSEQUENCE": "consequence_ids"}


def _typed(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("target"))


def norm_edges(norms: DataFrame, id_col: str = "id") -> DataFrame:
    """The six families of edges from norms to their parts."""
    each = F.flatten(F.array(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _typed(t)) for t, c in ROLES.items()]))
    return norms.select(F.col(id_col).alias("source"), F.explode(each).alias("e")).select("source", "e.target", "e.type")


def simple_edges(relations: DataFrame, norms: DataFrame) -> DataFrame:
    """Modality and object relations of nodes without a norm as direct edges."""
    return relations.join(norms.select(F.col("provenance_node_id").alias("node_id")), "node_id", "left_anti").where("source_id is not null").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("type"))


def reference_scope(text: Column, external: str = r"(?:luật|nghị định|thông tư|bộ luật)\s+(?!này)\S+") -> Column:
    """struct(scope, rule_id, captures): another law first, then the first pattern, in order, that is found.

    As the general article pattern stands before the longer absolute ones, these are found only if a pattern list puts
    them first.
    """
    return _scope(T.squeezed(text), external)


EXTERNAL = r"(?:luật|nghị định|thông tư|bộ luật)\s+(?!này)\S+"


def _scope(t: Column, external: str = EXTERNAL) -> Column:
    """`reference_scope` of a text that is squeezed."""
    empty = F.create_map().cast("map<string,string>")
    found = F.when(t.rlike(external), F.struct(F.lit("EXTERNAL_LAW").alias("scope"), F.lit("REF_EXTERNAL").alias("rule_id"), empty.alias("captures")))
    for rule, pattern, scope, names in REFERENCE_PATTERNS:
        captured = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(t, pattern, i + 1))]) if names else empty
        found = found.when(t.rlike(pattern), F.struct(F.lit(scope).alias("scope"), F.lit(rule).alias("rule_id"), captured.alias("captures")))
    return found.otherwise(F.struct(F.lit("AMBIGUOUS").alias("scope"), F.lit("REF_NONE").alias("rule_id"), empty.alias("captures")))


def classify_references(mentions: DataFrame, norms: DataFrame) -> DataFrame:
    """Reference mentions with scope and owner: the node's norm, else its first other mention, else none."""
    refs = mentions.where("semantic_type = 'Reference'").withColumn("__s", reference_scope(F.col("text")))
    owner = norms.groupBy(F.col("provenance_node_id").alias("node_id")).agg(F.min("id").alias("norm_id"))
    first = mentions.where("semantic_type <> 'Reference' and status <> 'QUARANTINED'").groupBy("node_id").agg(F.min_by("mention_id", "pos").alias("owner_mention"))
    return refs.join(owner, "node_id", "left").join(first, "node_id", "left").select("mention_id", "node_id", "text", "__s.scope", "__s.rule_id", "__s.captures", "norm_id", F.when(F.col("norm_id").isNull(), F.col("owner_mention")).alias("owner_mention"))


def edge_reasons(edges: DataFrame, mentions: DataFrame, norms: DataFrame, concepts: DataFrame) -> DataFrame:
    """With `reason`: why an edge leaves the active graph, or null. Ends are looked up in one table of typed ids."""
    kinds = mentions.select(F.col("mention_id").alias("id"), F.col("semantic_type").alias("kind")).unionByName(norms.select("id", F.lit("Norm").alias("kind"))).unionByName(concepts.select(F.col("concept_id").alias("id"), F.lit("Concept").alias("kind")))
    kinds = kinds.groupBy("id").agg(F.min("kind").alias("kind"))
    e = edges.join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("a")), "source", "left").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("b")), "target", "left")
    return e.withColumn("reason", _edge_reason(F.coalesce("a", F.lit("?")), F.coalesce("b", F.lit("?")), F.col("type"))).drop("a", "b")


def _edge_reason(a: Column, b: Column, t: Column) -> Column:
    """By the kinds of both ends, ? if there is no such end, and the type."""
    wanted = _map(MODIFIERS)[t]
    modifier = _among(t, list(MODIFIERS))
    attached = (a == "Norm") | ((t == "HAS_EXCEPTION") & (a == "Exception"))
    return (
        F.when((t == "DENOTES") & (b != "Concept"), "DENOTES_TARGET").when((t == "DENOTES") & (a == "Norm"), "DENOTES_SOURCE")
        .when(modifier & ~attached, F.concat(F.lit("UNATTACHED_"), F.substring(t, 5, 20)))
        .when(modifier & (b == "?"), "MISSING_ENDPOINT").when(modifier & (b != wanted), "TARGET_TYPE")
        .when((t == "HAS_OBJECT") & ((a == "?") | (b == "?")), "MISSING_ENDPOINT").when((t == "HAS_OBJECT") & ~_among(a, ["Norm", "LegalAction"]), "SOURCE_TYPE").when((t == "HAS_OBJECT") & (b != "LegalObject"), "TARGET_TYPE")
        .when(_among(t, MODALITIES) & (a == "?"), "MISSING_ENDPOINT").when(_among(t, MODALITIES) & (a != "Norm") & (b == "?"), "MISSING_ENDPOINT")
        .when(_among(t, MODALITIES) & ~_among(a, ["Norm", "LegalSubject"]), "SOURCE_TYPE").when(_among(t, MODALITIES) & (a == "LegalSubject") & (b != "LegalAction"), "TARGET_TYPE")
    )


def normative_concept_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Normative edges that begin at a concept, of which there should be none."""
    return edges.where(F.col("type").isin(*MODALITIES, *ROLES)).join(concepts.select(F.col("concept_id").alias("source")), "source", "left_semi")


def cascade_norms(norms: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(norms whose parts are all active mentions, norms that have lost every action). Parts that are gone leave the arrays."""
    alive = active.select(F.col("mention_id").alias("target"), F.lit(True).alias("alive"))
    parts = norm_edges(norms).join(alive, "target", "left_semi")
    kept = parts.groupBy(F.col("source").alias("id")).agg(*[F.sort_array(F.collect_set(F.when(F.col("type") == t, F.col("target")))).alias(f"__{c}") for t, c in ROLES.items()])
    none = F.array().cast("array<string>")
    # the order of the arrays stays that of the norm
    out = norms.join(kept, "id", "left").withColumns({c: F.array_intersect(F.col(c), F.coalesce(f"__{c}", none)) for c in ROLES.values()}).drop(*[f"__{c}" for c in ROLES.values()])
    out = out.withColumn("norm_completeness", F.when(F.size("subject_ids") > 0, "COMPLETE").otherwise("PARTIAL")).withColumn("subject_status", F.when(F.size("subject_ids") > 0, "RESOLVED").otherwise("UNRESOLVED"))
    return out.where(F.size("action_ids") > 0), out.where(F.size("action_ids") == 0).withColumn("status", F.lit("QUARANTINED"))


def cascade_edges(edges: DataFrame, active: DataFrame, quarantined: DataFrame) -> DataFrame:
    """With `reason`: DEPENDENCY_QUARANTINED if an end is quarantined, else MISSING_ENDPOINT if one is nowhere. Both tables have a column id."""
    out = edges
    for end in ("source", "target"):
        out = out.join(active.select(F.col("id").alias(end), F.lit(True).alias(f"__a_{end}")).distinct(), end, "left").join(quarantined.select(F.col("id").alias(end), F.lit(True).alias(f"__q_{end}")).distinct(), end, "left")
    q, a = F.coalesce("__q_source", "__q_target"), F.col("__a_source").isNull() | F.col("__a_target").isNull()
    return out.withColumn("reason", F.when(q.isNotNull(), "DEPENDENCY_QUARANTINED").when(a, "MISSING_ENDPOINT")).drop(*[f"__{x}_{e}" for x in "aq" for e in ("source", "target")])


def repair_owners(references: DataFrame, norms: DataFrame, mentions: DataFrame) -> DataFrame:
    """References whose owner is gone get the smallest norm of their node, else its smallest mention; `status` tells which are left without."""
    norm = norms.groupBy(F.col("provenance_node_id").alias("node_id")).agg(F.min("id").alias("__norm"))
    other = mentions.where("semantic_type <> 'Reference'").groupBy("node_id").agg(F.min("mention_id").alias("__mention"))
    alive_n, alive_m = norms.select(F.col("id").alias("norm_id"), F.lit(True).alias("__n")), mentions.select(F.col("mention_id").alias("owner_mention"), F.lit(True).alias("__m"))
    r = references.join(alive_n, "norm_id", "left").join(alive_m, "owner_mention", "left").join(norm, "node_id", "left").join(other, "node_id", "left")
    good = F.col("__n").isNotNull() | F.col("__m").isNotNull()
    new_norm = F.when(good, F.col("norm_id")).otherwise(F.col("__norm"))
    new_mention = F.when(good, F.col("owner_mention")).when(F.col("__norm").isNull(), F.col("__mention"))
    rest = [c for c in references.columns if c not in ("norm_id", "owner_mention")]
    return r.select(*rest, new_norm.alias("norm_id"), new_mention.alias("owner_mention"), F.when(new_norm.isNull() & new_mention.isNull(), "QUARANTINED").otherwise("VALID").alias("status"))


def unlinked_mentions(mentions: DataFrame, edges: DataFrame, norms: DataFrame, references: DataFrame) -> DataFrame:
    """Mentions that no edge, norm or reference touches."""
    used = edges.select(F.col("source").alias("mention_id")).unionByName(edges.select(F.col("target").alias("mention_id"))).unionByName(norm_edges(norms).select(F.col("target").alias("mention_id"))).unionByName(references.select("mention_id")).unionByName(references.select(F.col("owner_mention").alias("mention_id")))
    return mentions.join(used.where("mention_id is not null").distinct(), "mention_id", "left_anti")


def audit(before: dict[str, int], active: dict[str, DataFrame], quarantined: dict[str, DataFrame]) -> dict[str, bool]:
    """Conservation: active and quarantined rows together are as many as before, for each kind."""
    return {k: active[k].count() + quarantined[k].count() == n for k, n in before.items()}


def violations(mentions: DataFrame, norms: DataFrame, references: DataFrame) -> DataFrame:
    """One row: mentions without provenance or evidence, norms whose subject status is wrong, references without owner, self-owned ids."""
    m = mentions.agg(F.count_if((F.trim(F.coalesce("node_id", F.lit(""))) == "") | (F.trim(F.coalesce("evidence", F.lit(""))) == "")).alias("unproven_mentions"))
    n = norms.agg(F.count_if((F.col("subject_status") == "RESOLVED") != (F.size("subject_ids") > 0)).alias("wrong_subject_status"), F.count_if(F.size("action_ids") == 0).alias("norms_without_action"))
    r = references.agg(F.count_if(F.col("norm_id").isNull() & F.col("owner_mention").isNull()).alias("references_without_owner"))
    return m.join(F.broadcast(n)).join(F.broadcast(r))  # one row each


#: Counts that must be zero in a finished graph.
FATAL = ("broken_endpoints", "broken_norm_references", "broken_reference_owners", "active_quarantine_overlap", "duplicate_ids", "duplicate_edges", "domain_range_violations", "provenance_violations")


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("id"))


def _counted(name: str, df: DataFrame, n: Column | None = None) -> DataFrame:
    return df.agg(F.lit(name).alias("metric"), F.coalesce(n if n is not None else F.count("*"), F.lit(0)).cast("long").alias("n"))


def metrics(graph: dict[str, DataFrame], physical: DataFrame | None = None) -> DataFrame:
    """(metric, n): the counts of FATAL for a graph as from `build`; physical: nodes (column id) that provenance must name."""
    mentions, norms, concepts, references, edges = (graph[k] for k in ("mentions", "norms", "concepts", "references", "edges"))
    own = _ids(mentions, "mention_id"), _ids(norms, "id"), _ids(concepts, "concept_id")
    known = own[0].unionByName(own[1]).unionByName(own[2])
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    out = _counted("broken_endpoints", ends.join(known, "id", "left_anti"))
    out = out.unionByName(_counted("broken_norm_references", norm_edges(norms).select(F.col("target").alias("id")).join(own[0], "id", "left_anti")))
    by_norm = references.join(own[1].withColumnRenamed("id", "norm_id"), "norm_id", "left_semi").select("mention_id")
    by_mention = references.join(own[0].withColumnRenamed("id", "owner_mention"), "owner_mention", "left_semi").select("mention_id")
    out = out.unionByName(_counted("broken_reference_owners", references.join(by_norm.unionByName(by_mention), "mention_id", "left_anti")))
    gone = _ids(graph["quarantined_mentions"], "mention_id").unionByName(_ids(graph["quarantined_norms"], "id")).unionByName(_ids(graph["quarantined_references"], "mention_id"))
    out = out.unionByName(_counted("active_quarantine_overlap", own[0].unionByName(own[1]).distinct().join(gone, "id", "left_semi")))
    twice = known.groupBy("id").count().where("count > 1")
    out = out.unionByName(_counted("duplicate_ids", twice, F.sum(F.col("count") - 1)))
    out = out.unionByName(_counted("duplicate_edges", edges.groupBy("source", "type", "target").count().where("count > 1"), F.sum(F.col("count") - 1)))
    out = out.unionByName(_counted("domain_range_violations", edge_reasons(edges.select("source", "target", "type"), mentions, norms, concepts).where("reason is not null")))
    proven = mentions.select("node_id").unionByName(norms.select(F.col("provenance_node_id").alias("node_id"))).unionByName(references.select("node_id"))
    by_node = proven.groupBy("node_id").agg(F.count("*").alias("rows"))
    lost = by_node.join(physical.select(F.col("id").alias("node_id")), "node_id", "left_anti") if physical is not None else by_node.limit(0)
    return out.unionByName(_counted("provenance_violations", lost, F.sum("rows")))


def recomputed_report(graph: dict[str, DataFrame]) -> DataFrame:
    """(metric, n): how many mentions, norms, edges, references and concepts there are, by their state."""
    m, n, r = graph["mentions"], graph["norms"], graph["references"]
    many = lambda df, **conditions: [_counted(k, df, F.count_if(c)) for k, c in conditions.items()]
    rows = [_counted("active_mentions", m), *many(m, valid_mentions=F.col("status") == "VALID", corrected_mentions=F.col("status") == "CORRECTED", unresolved_mentions=F.col("status") == "UNRESOLVED"), _counted("quarantined_mentions", graph["quarantined_mentions"])]
    rows += [_counted("active_norms", n), *many(n, valid_norms=F.col("status") == "VALID", partial_norms=F.col("norm_completeness") == "PARTIAL"), _counted("quarantined_norms", graph["quarantined_norms"])]
    rows += [_counted("active_edges", graph["edges"]), _counted("quarantined_edges", graph["quarantined_edges"])]
    rows += [_counted("active_references", r), *many(r, ambiguous_references=F.col("scope") == "AMBIGUOUS", classified_references=F.col("scope") != "AMBIGUOUS"), _counted("quarantined_references", graph["quarantined_references"])]
    rows += [_counted("total_concepts", graph["concepts"])]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def finalize(graph: dict[str, DataFrame], before: dict[str, int] | None = None, physical: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph after its cascades and repairs, with `unlinked_mentions`, `metrics` and `report`; an error if a fatal count is not zero.

    Norms lose parts that are gone, edges go with their ends, references get owners that are there; the mention of a
    reference that finds none is quarantined with it. before: counts of mentions and norms that went in, which must all
    come out as active or quarantined ones. The tables are staged, so the counts of the gate read no more than footers
    and keys.
    """
    concepts = graph["concepts"]
    alive = staged(cascade_norms(graph["norms"], graph["mentions"])[0], "norms")
    owners = staged(repair_owners(graph["references"].drop("status"), alive, graph["mentions"]), "references")
    unowned = graph["quarantined_references"].unionByName(owners.where("status <> 'VALID'"))
    orphans = unowned.select("mention_id").distinct()
    mentions = staged(graph["mentions"].join(orphans, "mention_id", "left_anti"), "mentions")
    orphaned = graph["mentions"].join(orphans, "mention_id", "left_semi").withColumn("status", F.lit("QUARANTINED"))
    graph = graph | {"mentions": mentions, "quarantined_mentions": graph["quarantined_mentions"].unionByName(orphaned)}
    graph["quarantined_mentions"] = staged(graph["quarantined_mentions"], "mentions-quarantined")
    norms, lost = cascade_norms(graph["norms"], mentions)
    norms, lost = staged(norms, "norms"), staged(lost, "norms-lost")
    gone = _ids(graph["quarantined_mentions"], "mention_id").unionByName(_ids(lost, "id")).unionByName(_ids(graph["quarantined_norms"], "id"))
    active = _ids(mentions, "mention_id").unionByName(_ids(norms, "id")).unionByName(_ids(concepts, "concept_id"))
    edges = staged(cascade_edges(graph["edges"], active, gone), "edges")
    out = graph | {
        "norms": norms, "edges": edges.where("reason is null").drop("reason"), "references": owners.where("status = 'VALID'"),
        "quarantined_norms": graph["quarantined_norms"].unionByName(lost), "quarantined_edges": graph["quarantined_edges"].unionByName(edges.where("reason is not null")),
        "quarantined_references": unowned,
    }
    return _gated(out, before, physical)


def _gated(out: dict[str, DataFrame], before: dict[str, int] | None, physical: DataFrame | None) -> dict[str, DataFrame]:
    """With `unlinked_mentions`, `metrics` and `report`; an error if the graph does not hold together."""
    out["unlinked_mentions"] = unlinked_mentions(out["mentions"], out["edges"], out["norms"], out["references"])
    out["metrics"] = staged(metrics(out, physical), "metrics")
    out["report"] = recomputed_report(out).unionByName(out["metrics"])
    wrong = {r["metric"]: r["n"] for r in out["metrics"].where("n > 0").collect()}  # one row for each of FATAL
    kept = audit(before or {}, out, {k: out[f"quarantined_{k}"] for k in before or {}})
    wrong |= {f"{k}_conserved": False for k, good in kept.items() if not good}
    if wrong:
        raise ValueError(f"the graph fails its integrity gate: {wrong}")
    return out


def mention(graph: dict[str, DataFrame], mention_id: str) -> DataFrame:
    """The mention of an id, or none."""
    return graph["mentions"].where(F.col("mention_id") == mention_id)


def _let(value: Column, f) -> Column:
    """f of a value that is made once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _field(name: str):
    return lambda x: x[name]


def _is(name: str, value: Column | str):
    return lambda x: x[name] == value


def _found(items: Column, name: str, value: Column | str) -> Column:
    """The first item with that value, or null."""
    return F.get(F.filter(items, _is(name, value)), F.lit(0))


def _firsts(items: Column, key) -> Column:
    """Items whose key, which is not null, no earlier one has."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: key(y) == key(x)))


def _built(extractions: DataFrame, rules: DataFrame, vague: list[str]) -> DataFrame:
    """A row for each extraction, with all that follows from its own entities and relations: (node_id, reason, mentions, norm, edges, references).

    The steps are those of `filter_entities`, `filter_relations`, `normalize_entities`, `normalize_relations`, `gate`, `modality`,
    `build_norms`, `cascade_norms`, `edge_reasons`, `classify_references` and `finalize`; as none looks beyond its node, they are
    array functions of one row, and nothing is moved or sorted.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("the rule table is too large to be sent to all tasks")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(extractions.schema[c].dataType))
    rows = extractions.select("node_id", (F.col("entities").isNull() & F.col("relations").isNull()).alias("none"), listed("entities").alias("entities"), listed("relations").alias("relations"))
    texts = F.array(F.transform("entities", _field("text")), F.transform("entities", _field("evidence")), F.transform("relations", _field("evidence")))
    plain = F.array_join(F.flatten(texts), " ").rlike(T.NFC_ALREADY)
    rows = rows.withColumn("nfc", T.nfc_all(texts, plain))
    table = rules.agg(F.array_sort(F.collect_list(F.struct("rule_no", "rule_id", "m6_type", "triggers", "negative_triggers", "subtype", "concept_id", "action", "confidence", "head_guard"))).alias("rules"))
    rows = rows.join(F.broadcast(table))  # one row
    node, empty = F.col("node_id"), F.lit("")
    quality = lambda t: F.coalesce(T.squeezed_nfc(t), empty)
    norm_kinds = {"subject_ids": "LegalSubject", "action_ids": "LegalAction", "object_ids": "LegalObject", "condition_ids": "Condition", "exception_ids": "Exception", "consequence_ids": "LegalConsequence"}

    # what is read of the texts lies beside the entities and relations
    kind = lambda c: lambda x: F.upper(F.trim(F.coalesce(x[c], empty)))
    rows = rows.withColumns({
        "said": F.transform(F.get("nfc", F.lit(0)), T.squeezed_nfc), "entity_kinds": F.transform("entities", kind("entity_type")), "relation_kinds": F.transform("relations", kind("relation_type")),
        "proofs": F.transform(F.get("nfc", F.lit(1)), quality), "relation_proofs": F.transform(F.get("nfc", F.lit(2)), quality),
    })
    proven = lambda raw, t: ~t.isin(T.PLACEHOLDERS) & T.has_alnum(raw)

    def entity(x: Column, i: Column) -> Column:
        said, kind = F.get("said", i), F.get("entity_kinds", i)
        good = (F.trim(F.coalesce(x["id"], empty)) != "") & ~F.coalesce(said, empty).isin(T.PLACEHOLDERS) & _among(kind, ENTITY_TYPES) & proven(x["evidence"], F.get("proofs", i))
        return F.when(good, F.struct(i.alias("pos"), x["id"].alias("id"), x["text"].alias("text"), x["evidence"].alias("evidence"), kind.alias("kind"), F.upper(x["entity_type"]).alias("type"), said.alias("said")))

    accepted = _let(F.array_compact(F.transform("entities", entity)), lambda e: _firsts(e, _field("id")))

    def relations_of(e: Column) -> Column:
        def made(x: Column, i: Column) -> Column:
            there = F.exists(e, lambda y: F.coalesce(y["id"] == x["source"], F.lit(False)))
            reason = _relation_reason(x["source"], there, _found(e, "id", x["target"])["kind"], F.get("relation_kinds", i), x["source_status"], proven(x["evidence"], F.get("relation_proofs", i)))
            return F.when(reason.isNull(), F.struct(x["source"].alias("source"), x["target"].alias("target"), F.get("relation_kinds", i).alias("kind"), F.upper(x["relation_type"]).alias("type"), x["source_status"].alias("source_status"), F.get("relation_proofs", i).alias("said")))

        key = lambda x: F.struct(F.coalesce(x["source"], empty).alias("source"), x["kind"].alias("kind"), x["target"].alias("target"), x["said"].alias("said"))
        return _let(F.array_compact(F.transform("relations", made)), lambda r: _firsts(r, key))

    def mention(typed: Column):
        def made(x: Column, i: Column) -> Column:
            def fits(r: Column) -> Column:
                hit = F.exists(r["triggers"], lambda t: F.contains(x["said"], t)) & ~F.exists(r["negative_triggers"], lambda t: F.contains(x["said"], t))
                return (r["m6_type"] == x["type"]) & hit & ~(F.coalesce(r["head_guard"], F.lit(False)) & (x["type"] == "SUBJECT") & has_subject_head(x["text"], x["said"]))

            def ruled(rule: Column) -> Column:
                status = _ruled(rule, x["type"])
                known = _among(status, ["QUARANTINED", "CORRECTED"])
                evidence = F.when(F.trim(F.coalesce(x["evidence"], empty)) == "", x["text"]).otherwise(x["evidence"])
                gated = F.when(F.trim(F.coalesce(evidence, empty)) == "", "QUARANTINED").when(_among(x["said"], list(vague)), "UNRESOLVED").otherwise(status)
                number = F.size(F.filter(F.slice(typed, F.lit(1), i + 1), _is("type", x["type"])))
                return F.struct(F.concat_ws("#", node, x["type"], number.cast("string")).alias("mention_id"), x["pos"].alias("pos"), x["id"].alias("entity_id"), _map(SEMANTIC_TYPES)[x["type"]].alias("semantic_type"), gated.alias("status"), F.when(known, rule["subtype"]).alias("subtype"), F.when(known, rule["concept_id"]).alias("concept_id"), rule["rule_id"].alias("rule_id"), x["text"].alias("text"), evidence.alias("evidence"), x["said"].alias("said"))

            return _let(F.get(F.filter("rules", fits), F.lit(0)), ruled)

        return made

    def mentions_of(e: Column) -> Column:
        return _let(F.filter(e, lambda x: _map(SEMANTIC_TYPES)[x["type"]].isNotNull()), lambda typed: F.transform(typed, mention(typed)))

    def linked(s: Column) -> Column:
        bad = F.transform(F.filter(s["m"], _is("status", "QUARANTINED")), _field("mention_id"))
        active = F.filter(s["m"], lambda x: x["status"] != "QUARANTINED")

        def link(x: Column) -> Column:
            to = lambda end: _found(s["m"], "entity_id", x[end])["mention_id"]
            return F.struct(to("source").alias("source"), to("target").alias("target"), _map(RELATION_TYPES)[x["type"]].alias("type"), F.upper(F.coalesce(x["source_status"], F.lit("RESOLVED"))).alias("status"))

        def stays(gone: Column):
            def told(x: Column) -> Column:
                named = x["type"].isNotNull() & x["target"].isNotNull() & (x["source"].isNotNull() | (x["status"] == "UNRESOLVED") & _among(x["type"], MODALITIES))
                return named & ~F.exists(gone, lambda g: (g == x["target"]) | F.coalesce(g == x["source"], F.lit(False)))

            return told

        links = _let(bad, lambda gone: F.filter(F.transform(s["r"], link), stays(gone)))
        by = F.filter(s["e"], lambda x: _among(x["type"], ["PERMISSION", "OBLIGATION"]))
        special = lambda x: _found(by, "id", x["target"])["type"]
        last = _let(F.get(F.reverse(F.array_compact(F.transform(s["r"], special))), F.lit(0)), lambda t: F.when(t == "PERMISSION", "ALLOW").when(t == "OBLIGATION", "REQUIRE"))
        plain_ = F.get(F.transform(F.filter(s["r"], lambda x: _among(x["type"], MODALITIES)), _field("type")), F.lit(0))
        return F.struct(active.alias("a"), links.alias("l"), F.coalesce(last, plain_).alias("modality"))

    def normed(s: Column) -> Column:
        ids = F.struct(*[F.transform(F.filter(s["a"], _is("semantic_type", k)), _field("mention_id")).alias(c) for c, k in norm_kinds.items()])
        evidence = F.array_join(F.slice(F.array_distinct(F.transform(s["a"], _field("evidence"))), 1, 3), " | ")

        def made(k: Column) -> Column:
            groups = "array<struct<group_id:string,operator:string,condition_ids:array<string>,is_complex:boolean>>"
            group = F.when(F.size(k["condition_ids"]) > 0, F.array(F.struct(F.lit("G1").alias("group_id"), F.lit("AND").alias("operator"), k["condition_ids"].alias("condition_ids"), F.lit(False).alias("is_complex")))).otherwise(F.array().cast(groups))
            more = F.exists(s["l"], _is("status", "UNRESOLVED")) | (F.size(k["condition_ids"]) > 0) | (F.size(k["exception_ids"]) > 0) | (F.size(k["consequence_ids"]) > 0) | (F.size(k["subject_ids"]) > 1)
            subject = F.size(k["subject_ids"]) > 0
            norm = F.struct(
                F.concat(node, F.lit("#NORM#1")).alias("id"), s["modality"].alias("modality"), *[k[c].alias(c) for c in norm_kinds], group.alias("condition_groups"), F.when(subject, "RESOLVED").otherwise("UNRESOLVED").alias("subject_status"),
                F.when(subject, "COMPLETE").otherwise("PARTIAL").alias("norm_completeness"), node.alias("provenance_node_id"), evidence.alias("evidence"), F.lit("NORM_BUILD").alias("rule_id"), F.when(F.size(k["action_ids"]) > 0, "VALID").otherwise("QUARANTINED").alias("status"),
            )
            return F.when((F.size(s["a"]) > 0) & s["modality"].isNotNull() & more, norm)

        return _let(ids, made)

    def whole(s: Column) -> Column:
        kept = F.coalesce(s["norm"]["status"] == "VALID", F.lit(False))
        norm_id = F.when(kept, s["norm"]["id"])
        edge = lambda source, target, type_: F.struct(source.alias("source"), target.alias("target"), type_.alias("type"))
        none = F.array().cast("array<struct<source:string,target:string,type:string>>")
        of_norm = F.flatten(F.array(*[F.transform(s["norm"][c], _from(norm_id, t)) for t, c in ROLES.items()]))
        of_links = F.transform(F.filter(s["l"], lambda x: x["source"].isNotNull()), lambda x: edge(x["source"], x["target"], x["type"]))
        denoted = F.transform(F.filter(s["a"], lambda x: x["concept_id"].isNotNull()), lambda x: edge(x["mention_id"], x["concept_id"], F.lit("DENOTES")))
        edges = F.array_distinct(F.concat(denoted, F.when(kept, F.coalesce(of_norm, none)).otherwise(of_links)))
        other = F.get(F.filter(s["a"], lambda x: x["semantic_type"] != "Reference"), F.lit(0))["mention_id"]
        # with neither a norm nor another mention in its node a reference has no owner: all mentions that are left are such references
        orphan = ~kept & other.isNull()

        def told(v: Column) -> Column:
            kind_of = lambda end: F.coalesce(F.when(end == v["norm_id"], F.lit("Norm")), _found(s["a"], "mention_id", end)["semantic_type"], F.lit("?"))
            ends = lambda x: F.struct(kind_of(x["source"]).alias("a"), F.when(x["type"] == "DENOTES", F.lit("Concept")).otherwise(kind_of(x["target"])).alias("b"))
            why = lambda x: _let(ends(x), lambda k: _edge_reason(k["a"], k["b"], x["type"]))
            reasoned = F.transform(v["edges"], lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["type"].alias("type"), F.coalesce(why(x), F.when(v["orphan"], "DEPENDENCY_QUARANTINED")).alias("reason")))

            def reference(x: Column) -> Column:
                found = lambda c: F.struct(x["mention_id"].alias("mention_id"), x["text"].alias("text"), c["scope"].alias("scope"), c["rule_id"].alias("rule_id"), c["captures"].alias("captures"), v["norm_id"].alias("norm_id"), F.when(v["norm_id"].isNull(), v["other"]).alias("owner_mention"), F.when(v["orphan"], "QUARANTINED").otherwise("VALID").alias("status"))
                return _let(_scope(x["said"]), found)

            final = lambda x: F.struct(x["mention_id"].alias("mention_id"), x["pos"].alias("pos"), x["entity_id"].alias("entity_id"), x["semantic_type"].alias("semantic_type"), F.when(v["orphan"], "QUARANTINED").otherwise(x["status"]).alias("status"), x["subtype"].alias("subtype"), x["concept_id"].alias("concept_id"), x["rule_id"].alias("rule_id"), x["text"].alias("text"), x["evidence"].alias("evidence"), (v["orphan"] & (x["status"] != "QUARANTINED")).alias("orphan"))
            return F.struct(F.transform(s["m"], final).alias("mentions"), s["norm"].alias("norm"), reasoned.alias("edges"), F.transform(F.filter(s["a"], _is("semantic_type", "Reference")), reference).alias("references"))

        return _let(F.struct(norm_id.alias("norm_id"), edges.alias("edges"), other.alias("other"), orphan.alias("orphan")), told)

    # a step a column: what is made is neither made twice nor copied on with the next
    found = rows.withColumn("e", accepted)
    found = found.withColumn("r", _let(F.col("e"), relations_of)).withColumn("m", _let(F.col("e"), mentions_of))
    found = found.withColumn("s", _let(F.struct("e", "r", "m"), linked)).withColumn("norm", _let(F.col("s"), normed))
    reason = F.when(F.trim(F.coalesce("node_id", empty)) == "", "missing_node_id").when(F.col("none"), "missing_extraction").when(F.size("e") == 0, "empty_after_filter")
    all_ = _let(F.struct("m", "s.a", "s.l", "norm"), whole)
    return found.select("node_id", reason.alias("reason"), F.when(reason.isNull(), all_).alias("x")).select("node_id", "reason", "x.*")


def _from(source: Column, kind: str):
    return lambda x: F.struct(source.alias("source"), x.alias("target"), F.lit(kind).alias("type"))


def build(extractions: DataFrame, rules: DataFrame, registry: DataFrame, vague: list[str] = ("việc này", "điều này", "nội dung này"), physical: DataFrame | None = None) -> dict[str, DataFrame]:
    """Extractions to the canonical graph: mentions, concepts, norms, references, edges, what is quarantined, metrics and report.

    Nodes without id, extraction or accepted entity are `rejected_nodes`. Several extractions of a node are taken as one.
    The graph goes through the gate of `finalize`, so an error is raised if it does not hold together.
    """
    nodes = staged(_built(extractions, rules, vague), "built-nodes")
    if not nodes.groupBy("node_id").count().where("count > 1").isEmpty():
        together = extractions.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("entities", "relations"))).alias("x"))
        joined = lambda c: F.when(F.exists("x", lambda x: x[c].isNotNull()), F.flatten(F.array_compact(F.transform("x", _field(c))))).alias(c)
        nodes = staged(_built(together.select("node_id", joined("entities"), joined("relations")), rules, vague), "built-nodes")
    each = lambda c: nodes.select("node_id", F.explode(c).alias("x"))
    mentions = each("mentions").select("x.mention_id", "node_id", *[f"x.{c}" for c in ("pos", "entity_id", "semantic_type", "status", "subtype", "concept_id", "rule_id", "text", "evidence", "orphan")])
    mentions = staged(mentions, "mentions")
    norms = staged(nodes.where("norm is not null").select("norm.*"), "norms")
    edges = staged(each("edges").select("x.*"), "edges")
    references = staged(each("references").select("x.mention_id", "node_id", "x.text", "x.scope", "x.rule_id", "x.captures", "x.norm_id", "x.owner_mention", "x.status"), "references")
    concepts = staged(concepts_used(mentions.where("status <> 'QUARANTINED' or orphan"), registry), "concepts")
    before = nodes.agg(F.sum(F.size("mentions")).alias("mentions"), F.count("norm").alias("norms")).first()  # one row
    mentions = mentions.drop("orphan")
    graph = {
        "mentions": mentions.where("status <> 'QUARANTINED'"), "concepts": concepts, "norms": norms.where("status = 'VALID'"), "references": references.where("status = 'VALID'"), "edges": edges.where("reason is null").drop("reason"),
        "rejected_nodes": nodes.where("reason is not null").select("node_id", "reason"), "quarantined_mentions": mentions.where("status = 'QUARANTINED'"), "quarantined_norms": norms.where("status = 'QUARANTINED'"), "quarantined_edges": edges.where("reason is not null"),
        "quarantined_references": references.where("status <> 'VALID'"),
    }
    return _gated(graph, {k: before[k] or 0 for k in ("mentions", "norms")}, physical)
