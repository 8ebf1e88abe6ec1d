"""Fusion of the physical and the semantic graph: norms merged by content, references resolved, conflicts, snapshots compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import partitions, staged
from .ontology import MODALITIES, ROLES, norm_edges


def adapt(norms: DataFrame, edges: DataFrame, denotes: DataFrame) -> DataFrame:
    """Norms and direct edges to relations (norm_id, source_node_id, source, target, relation_type).

    Ends that denote a concept are replaced by it. A norm is one relation for each of its subjects and actions, or one
    with an empty end where it has none, and one for each modifier.
    """
    to_concept = denotes.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("concept"))

    def canonical(df: DataFrame, c: str) -> DataFrame:
        return df.join(to_concept.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("concept", c)).drop("concept")

    valid = norms.where("status = 'VALID'")
    or_none = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))
    cores = valid.select(F.col("id").alias("norm_id"), F.col("provenance_node_id").alias("source_node_id"), F.explode(or_none("subject_ids")).alias("source"), F.col("modality").alias("relation_type"), or_none("action_ids").alias("a")).withColumn("target", F.explode("a")).drop("a")
    owner = valid.select(F.col("id").alias("norm_id"), F.col("provenance_node_id").alias("source_node_id"))
    rest = norm_edges(valid).where(~F.col("type").isin("HAS_SUBJECT", "HAS_ACTION")).select(F.col("source").alias("norm_id"), "target", F.col("type").alias("relation_type")).join(owner, "norm_id").withColumn("source", F.lit(None).cast("string"))
    direct = edges.where(~F.col("type").isin("HAS_SUBJECT", "HAS_ACTION", "DENOTES")).join(valid.select(F.col("id").alias("source")), "source", "left_anti")
    direct = direct.select(F.lit(None).cast("string").alias("norm_id"), F.lit(None).cast("string").alias("source_node_id"), "source", "target", F.col("type").alias("relation_type"))
    return canonical(canonical(cores.unionByName(rest).unionByName(direct), "source"), "target").select("norm_id", "source_node_id", "source", "target", "relation_type")


def norm_contents(relations: DataFrame) -> DataFrame:
    """Relations of norms to one row a norm with its sorted distinct parts."""
    core = F.col("relation_type").isin(MODALITIES)
    ids = lambda c, when: F.sort_array(F.collect_set(F.when(when, F.col(c))))
    parts = {"subject_ids": ids("source", core), "action_ids": ids("target", core)} | {c: ids("target", F.col("relation_type") == t) for t, c in ROLES.items() if c not in ("subject_ids", "action_ids")}
    return relations.where("norm_id is not null").groupBy("norm_id").agg(F.coalesce(F.max(F.when(core, F.col("relation_type"))), F.lit("ALLOW")).alias("modality"), F.min("source_node_id").alias("source_node_id"), *[v.alias(k) for k, v in parts.items()])


def fuse_norms(contents: DataFrame, extra: tuple = ()) -> DataFrame:
    """Norms of equal content are one: (id, modality, the parts, source_node_ids, source_norm_ids).

    The key is an MD5 over the JSON of modality and sorted parts (and the columns `extra`), so that lists cannot run
    into each other.
    """
    key = F.concat(F.lit("GNORM_"), F.substring(F.md5(F.to_json(F.struct("modality", *ROLES.values(), *extra)).cast("binary")), 1, 12))
    return contents.withColumn("id", key).groupBy("id").agg(
        F.first("modality").alias("modality"), *[F.first(c).alias(c) for c in (*ROLES.values(), *extra)], F.sort_array(F.collect_set("source_node_id")).alias("source_node_ids"), F.sort_array(F.collect_set("norm_id")).alias("source_norm_ids")
    )


def scoped(norms: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A row for each norm, subject and action: (id, subject, action, modality, conditions, objects, has_exception).

    norms: (id, modality, the six arrays); texts: (id, canonical_text) of conditions.
    """
    each = norms.select("id", "modality", "condition_ids", "exception_ids", "object_ids", F.explode("subject_ids").alias("subject"), "action_ids").withColumn("action", F.explode("action_ids")).drop("action_ids")
    if texts is not None:
        told = norms.select("id", F.explode("condition_ids").alias("c")).join(texts.select(F.col("id").alias("c"), F.trim(F.lower("canonical_text")).alias("t")), "c", "left")
        told = told.groupBy("id").agg(F.sort_array(F.collect_list(F.coalesce("t", F.lit("")))).alias("conditions"))
        each = each.join(told, "id", "left")
    else:
        each = each.withColumn("conditions", F.sort_array("condition_ids"))
    each = each.withColumns({"conditions": F.coalesce("conditions", F.array().cast("array<string>")), "objects": F.sort_array(F.array_distinct("object_ids")), "has_exception": F.coalesce(F.size("exception_ids") > 0, F.lit(False))})
    return each.drop("condition_ids", "exception_ids", "object_ids").where("subject is not null and action is not null")


#: Rows of one side of a key that one task pairs with as many of the other.
BLOCK = 1024
#: Rows of a snapshot that a task compares.
ROWS = 250_000


def paired(left: DataFrame, right: DataFrame, keys: tuple, block: int = BLOCK) -> DataFrame:
    """The inner join of two tables on `keys`, where a key with many rows on both sides is dealt in blocks.

    Each side of such a key is cut into blocks of about `block` rows by a hash of the row, and sent once for each block of
    the other side: a task then makes about block * block pairs, and the copies are a `block`-th of the pairs. Other
    columns must have different names.
    """
    count = lambda df, c: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(c))
    cut = count(left, "__i").join(count(right, "__j"), list(keys)).where("__i > 1 or __j > 1")
    one = lambda c: F.coalesce(c, F.lit(1))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), one(own)).cast("int")
        rows = df.join(cut, list(keys), "left").withColumns({own: at, other: F.sequence(F.lit(0), one(other) - 1)})
        return rows.withColumn(other, F.explode(other))

    both = dealt(left, "__i", "__j").join(dealt(right, "__j", "__i"), [*keys, "__i", "__j"])
    return both.drop("__i", "__j")


def conflicts(norms: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Pairs of a norm that allows or requires and one that prohibits the same action of the same subject.

    norms and texts as for `scoped`. The join is on subject and action, and hot ones are dealt in blocks; where a row a
    pair is too much, `conflict_classes` has the counts and the members.
    """
    each = scoped(norms, texts)
    named = lambda df, p: df.select("subject", "action", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "modality", "conditions", "objects", "has_exception")])
    pos = named(each.where(F.col("modality").isin("ALLOW", "REQUIRE")), "p")
    neg = named(each.where("modality = 'PROHIBIT'"), "n")
    both = paired(pos, neg, ("subject", "action"))
    s = scope(F.col("p_conditions"), F.col("n_conditions"), F.col("p_has_exception") | F.col("n_has_exception"), F.col("p_objects") == F.col("n_objects"))
    return both.select("subject", "action", F.col("p_id").alias("positive_id"), F.col("n_id").alias("prohibit_id"), F.concat("p_modality", F.lit("_PROHIBIT")).alias("conflict_type"), s.alias("s"), F.col("p_conditions").alias("positive_conditions"), F.col("n_conditions").alias("prohibit_conditions")).select("*", "s.flag", "s.context_status").drop("s")


def conflict_classes(norms: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The conflicts counted without a row a pair: (subject, action, conflict_type, flag, context_status, n_pairs, n_positive, n_prohibit).

    What decides a pair is either a mark of one side (an exception, a word of its conditions), or that conditions, then
    objects, are equal. So norms are counted by marks, conditions and objects; of a subject and action at most eight
    classes by marks meet eight, pairs of equal conditions meet by a join on them, and what is left of the product is the
    pairs of unequal ones. n_positive and n_prohibit are the norms of each side; `conflict_members` lists them, and
    `conflicts` on the norms of a chosen key expands it. Norms without subject, action or modality take no part.
    """
    key, rest = ["subject", "action"], ["conditions", "objects"]
    told = F.array_join("conditions", " ")
    marked = scoped(norms, texts).select(
        *key, "modality", "has_exception", F.sort_array(F.array_distinct("conditions")).alias("conditions"), "objects",
        F.contains(told, F.lit(NOT_ALLOWED)).alias("barred"), F.contains(told, F.lit(WITHOUT_FEE)).alias("free"), _fees(told).alias("fees"),
    )
    marks = {"p": ["modality", "p_exception", "fees"], "n": ["n_exception", "barred", "free"]}

    def counted(side: str, chosen: Column) -> DataFrame:
        found = marked.where(chosen).withColumnRenamed("has_exception", f"{side}_exception")
        return found.groupBy(*key, *marks[side], *rest).agg(F.count("*").alias(f"{side}_n"))

    pos = staged(counted("p", F.col("modality").isin("ALLOW", "REQUIRE")), "positive-norms")
    neg = staged(counted("n", F.col("modality") == "PROHIBIT"), "prohibiting-norms")

    def met(on: list) -> DataFrame:
        """Pairs by marks on both sides, of equal `on`."""
        sides = [df.groupBy(*key, *on, *marks[x]).agg(F.sum(f"{x}_n").alias(f"{x}_n")) for x, df in (("p", pos), ("n", neg))]
        return sides[0].join(sides[1], [*key, *on]).withColumn("pairs", F.col("p_n") * F.col("n_n"))

    def summed(df: DataFrame, name: str) -> DataFrame:
        return df.where("size(conditions) > 0").where(_open()).groupBy(*key, "modality").agg(F.sum("pairs").alias(name))

    all_pairs = met([]).withColumn("why", F.when(F.col("p_exception") | F.col("n_exception"), 0).when(F.col("barred"), 1).when(F.col("free") & F.col("fees"), 2).otherwise(3))
    by_why = all_pairs.groupBy(*key, "modality").agg(*[F.sum(F.when(F.col("why") == i, F.col("pairs")).otherwise(0)).alias(f"w{i}") for i in range(4)])
    equal, same = summed(met(["conditions"]), "equal"), summed(met(rest), "same")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = {WHY[0]: F.col("w0"), WHY[1]: F.col("w1"), WHY[2]: F.col("w2"), WHY[3]: zero("same"), WHY[4]: zero("equal") - zero("same"), WHY[5]: F.col("w3") - zero("equal")}
    rows = by_why.join(equal, [*key, "modality"], "left").join(same, [*key, "modality"], "left")
    rows = rows.withColumn("c", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.lit(w).alias("context_status"), v.cast("long").alias("n_pairs")) for (f, w), v in n.items()]))).where("c.n_pairs > 0")
    rows = rows.join(pos.groupBy(*key, "modality").agg(F.sum("p_n").alias("n_positive")), [*key, "modality"]).join(neg.groupBy(*key).agg(F.sum("n_n").alias("n_prohibit")), key)
    return rows.select(*key, F.concat("modality", F.lit("_PROHIBIT")).alias("conflict_type"), "c.flag", "c.context_status", "c.n_pairs", "n_positive", "n_prohibit")


def conflict_members(norms: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(subject, action, side, modality, id): the norms that stand behind the rows of `conflict_classes`, for keys that have both sides."""
    each = scoped(norms, texts).where(F.col("modality").isin("ALLOW", "REQUIRE", "PROHIBIT"))
    each = each.select("subject", "action", F.when(F.col("modality") == "PROHIBIT", "PROHIBIT").otherwise("POSITIVE").alias("side"), "modality", "id").distinct()
    both = each.groupBy("subject", "action").agg(F.count_if(F.col("side") == "PROHIBIT").alias("n"), F.count("*").alias("m")).where("n > 0 and m > n").select("subject", "action")
    return each.join(both, ["subject", "action"], "left_semi")


# What a pair of opposite norms comes to, as flag and reason, the first that holds.
WHY = [
    ("REVIEW_REQUIRED", "EXCEPTION_SCOPE_REQUIRES_REVIEW"),
    ("REVIEW_REQUIRED", "CONDITIONAL_PROHIBITION_REQUIRES_LEGAL_REVIEW"),
    ("CONTEXTUAL_DIFFERENCE", "DISTINCT_LAND_PAYMENT_REGIMES"),
    ("POTENTIAL_LEGAL_CONFLICT", "MATCHING_EXPLICIT_CONDITIONS"),
    ("REVIEW_REQUIRED", "OBJECT_SCOPE_NOT_PROVEN_EQUAL"),
    ("REVIEW_REQUIRED", "CONDITION_SCOPE_NOT_PROVEN_EQUAL"),
]
# Texts of conditions that decide a scope.
NOT_ALLOWED, WITHOUT_FEE, WITH_FEES = "pháp luật không cho phép", "không thu tiền sử dụng đất", ["có thu tiền sử dụng đất", "thu tiền thuê đất một lần", "thu tiền thuê đất hằng năm"]


def _fees(told: Column) -> Column:
    return F.contains(told, F.lit(WITH_FEES[0])) | F.contains(told, F.lit(WITH_FEES[1])) | F.contains(told, F.lit(WITH_FEES[2]))


def _open() -> Column:
    """Whether no mark of either side decides a pair of `conflict_classes`."""
    return ~(F.col("p_exception") | F.col("n_exception") | F.col("barred") | F.col("free") & F.col("fees"))


def scope(allowed: Column, prohibited: Column, has_exception: Column, same_objects: Column) -> Column:
    """struct(flag, context_status) of a pair of opposite norms."""
    n, p = F.array_join(prohibited, " "), F.array_join(allowed, " ")
    fees = _fees(p)
    equal = (F.size(allowed) > 0) & (F.size(prohibited) > 0) & (F.sort_array(F.array_distinct(allowed)) == F.sort_array(F.array_distinct(prohibited)))
    told = [F.struct(F.lit(flag).alias("flag"), F.lit(why).alias("context_status")) for flag, why in WHY]
    return (
        F.when(has_exception, told[0])
        .when(F.contains(n, F.lit(NOT_ALLOWED)), told[1])
        .when(F.contains(n, F.lit(WITHOUT_FEE)) & fees, told[2])
        .when(equal & same_objects, told[3])
        .when(equal, told[4])
        .otherwise(told[5])
    )


def reviews(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conflicts to review nodes REVIEW_nnn and their edges to the two norms, the subject and the action.

    Numbers are in the order of subject, action and ids: the rows are sorted in ranges and counted range by range, so that
    no task holds them all.
    """
    order = ("subject", "action", "conflict_type", "positive_id", "prohibit_id")
    rows = staged(found.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "reviews")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    n = rows.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("id", F.format_string("REVIEW_%03d", F.col("__start") + place + 1))
    ends = F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).alias("target")) for t, c in (("REVIEWS_POSITIVE", "positive_id"), ("REVIEWS_PROHIBITION", "prohibit_id"), ("CONCERNS_SUBJECT", "subject"), ("CONCERNS_ACTION", "action"))])
    e = n.select(F.col("id").alias("source"), F.explode(ends).alias("e")).select("source", "e.target", "e.type")
    return n.select("id", "flag", "conflict_type", "context_status"), e


def fuse(nodes: DataFrame, entities: DataFrame, relations: DataFrame, norms: DataFrame) -> dict[str, DataFrame]:
    """The fused graph. Mentions and references that nothing uses go; norms merge; edges with a missing end are told apart.

    nodes: physical rows (id, ..); entities: (id, fusion_kind, node_id); relations as from `adapt`; norms: with provenance.
    """
    merged = fuse_norms(norm_contents(relations))
    hubs = norm_edges(merged)
    direct = relations.where("norm_id is null").select("source", "target", F.col("relation_type").alias("type"))
    semantic = hubs.unionByName(direct).distinct()
    used = semantic.select(F.col("source").alias("id")).unionByName(semantic.select(F.col("target").alias("id"))).distinct()
    kept = entities.where(~F.col("fusion_kind").isin("MENTION", "REFERENCE")).unionByName(entities.where(F.col("fusion_kind").isin("MENTION", "REFERENCE")).join(used, "id", "left_semi"))
    told = kept.where("node_id is not null").select(F.col("node_id").alias("source"), F.col("id").alias("target"), F.lit("MENTIONS").alias("type")).distinct()
    ids = nodes.select("id").unionByName(kept.select("id")).unionByName(merged.select("id")).distinct()
    alive = lambda e: e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    edges = semantic.unionByName(told)
    good = alive(edges)
    return {"entities": kept, "norms": merged, "edges": good.select("source", "target", "type"), "rejected_edges": edges.join(good, ["source", "target", "type"], "left_anti"), "conflicts": conflicts(merged)}


# References in text.
def resolve_by_number(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target): references (ref_id, law_code, article, clause, point) to the one node of that place.

    nodes: (id, law_code, article, clause, point), null below their level. A place with more than one node is ambiguous
    and resolves to none.
    """
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("law_code", "article", "clause", "point")])
    unique = nodes.withColumn("key", key).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1").select("key", "target")
    return references.withColumn("key", key).join(unique, "key").select("ref_id", "target")


def parts_of_reference(text: str) -> dict[str, Column]:
    """article, clause and point that a reference names, and `this` for the level it calls its own."""
    t = T.squeezed(text)
    got = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return {"article": got(r"điều\s+(\d+)"), "clause": got(r"khoản\s+(\d+)"), "point": got(r"điểm\s+([a-zđ])(?=\s|\z)"), "chapter": got(r"chương\s+([ivxlcdm\d]+)"), "section": got(r"mục\s+(\d+)"), "this": got(r"(khoản|điều|mục|chương)\s+này")}


def anaphoric(references: DataFrame, closure: DataFrame) -> DataFrame:
    """(ref_id, target): "this clause", "this article" and the like, to the nearest such node at or above the source.

    references: (ref_id, source_node_id, text); closure: (id, label, ancestor), the node itself included.
    """
    label = F.create_map(*[F.lit(x) for kv in {"khoản": "CLAUSE", "điều": "ARTICLE", "mục": "SECTION", "chương": "CHAPTER"}.items() for x in kv])
    r = references.withColumn("label", label[parts_of_reference("text")["this"]]).where("label is not null")
    return r.join(closure.withColumnRenamed("id", "source_node_id"), ["source_node_id", "label"]).select("ref_id", F.col("ancestor").alias("target"))


def resolve(references: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(ref_id, targets, status): by number, else by "this ..", else unresolved.

    For references whose law is known, in nodes given by their numbers; texts of any kind go through references.resolve.
    """
    named = references.withColumns({k: v for k, v in parts_of_reference("text").items() if k in ("article", "clause", "point")})
    by_number = resolve_by_number(named.where("article is not null"), nodes).groupBy("ref_id").agg(F.sort_array(F.collect_set("target")).alias("by_number"))
    by_self = anaphoric(references, closure).groupBy("ref_id").agg(F.sort_array(F.collect_set("target")).alias("by_self"))
    r = named.join(by_number, "ref_id", "left").join(by_self, "ref_id", "left")
    status = F.when(F.col("by_number").isNotNull(), "RESOLVED_TEXT").when(F.col("by_self").isNotNull(), "RESOLVED_ANAPHORIC").when(F.col("article").isNotNull(), "AMBIGUOUS_OR_MISSING").otherwise("UNRESOLVED")
    return r.select("ref_id", F.coalesce("by_number", "by_self", F.array().cast("array<string>")).alias("targets"), status.alias("status"))


# Snapshots.
def row_hash(df: DataFrame, key: tuple) -> Column:
    """A hash of all columns but the key; nulls and types count."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in key]), {"ignoreNullFields": "false"}), 256)


def diff(old: DataFrame, new: DataFrame, key: tuple = ("id",)) -> DataFrame:
    """(key, change): ADDED, UPDATED or REMOVED; only keys and hashes are shuffled."""
    n = partitions(old.count(), ROWS)
    a = old.select(*key, row_hash(old, key).alias("__a")).repartition(n, *key)
    b = new.select(*key, row_hash(new, key).alias("__b")).repartition(n, *key)
    both = a.join(b, list(key), "full_outer")
    change = F.when(F.col("__a").isNull(), "ADDED").when(F.col("__b").isNull(), "REMOVED").when(F.col("__a") != F.col("__b"), "UPDATED")
    return both.withColumn("change", change).where("change is not null").select(*key, "change")


def upserts(new: DataFrame, changes: DataFrame, key: tuple = ("id",)) -> DataFrame:
    """The rows of the new snapshot that a difference adds or updates."""
    changed = changes.where("change <> 'REMOVED'").select(*key)
    return new.repartition(partitions(new.count(), ROWS), *key).join(changed, list(key), "left_semi")


def apply_delta(old: DataFrame, upserts: DataFrame, removed: DataFrame, key: tuple = ("id",)) -> DataFrame:
    """The old snapshot without what is removed or replaced, and the upserts."""
    gone = removed.select(*key).unionByName(upserts.select(*key)).distinct()
    return old.repartition(partitions(old.count(), ROWS), *key).join(gone, list(key), "left_anti").unionByName(upserts)


DELTA_KEYS = ("added_nodes", "updated_nodes", "removed_nodes", "added_edges", "updated_edges", "removed_edges")


def checked_delta(delta: dict) -> dict:
    missing = [k for k in DELTA_KEYS if k not in delta]
    if missing:
        raise ValueError(f"the delta lacks {missing}")
    return delta
