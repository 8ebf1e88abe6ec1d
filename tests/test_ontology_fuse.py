import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import fuse, ontology, references
from lexigrove.schemas import EXTRACTION
from lexigrove.sources.loaders import rule_table, trigger_collisions


def extraction(spark):
    e = lambda i, t, k, ev="evidence 1": (i, t, k, ev)
    r = lambda s, k, t, st="RESOLVED", ev="evidence 2": (s, k, t, st, ev)
    rows = [
        ("n1", [e("s", "Người dùng", "SUBJECT"), e("a", "chuyển nhượng", "ACTION"), e("c", "có giấy", "CONDITION"), e("s", "again", "SUBJECT"), e("x", "N/A", "OBJECT"), e("r", "khoản 2 Điều 48", "REFERENCE")], [r("s", "ALLOW", "a"), r("s", "ALLOW", "a"), r("a", "HAS_CONDITION", "c"), r("zz", "ALLOW", "a"), r(None, "PROHIBIT", "a", "UNRESOLVED")]),
        ("n2", [e("s", "hợp đồng", "SUBJECT"), e("a", "bán", "ACTION"), e("p", "được", "PERMISSION")], [r("s", "REQUIRE", "a"), r("s", "ALLOW", "p")]),
        ("n3", [e("s", "...", "SUBJECT")], []),
    ]
    return spark.createDataFrame(rows, EXTRACTION)


RULES = [
    {"id": "R1", "m6_type": "SUBJECT", "triggers": ["hợp đồng"], "target_subtype": "ContractObject", "target_concept_id": "X.OBJECT.CONTRACT", "action": "FLAG"},
    {"id": "R2", "m6_type": "SUBJECT", "triggers": ["người"], "negative_triggers": ["nước ngoài"], "target_subtype": "Person", "target_concept_id": "X.SUBJECT.PERSON"},
    {"id": "R3", "m6_type": "SUBJECT", "triggers": ["người", "hợp đồng"], "target_subtype": "Late", "target_concept_id": "X.SUBJECT.LATE"},
]


def test_filters(spark):
    e, r = ontology.exploded(extraction(spark))
    why = {(x.node_id, x.pos): x.reason for x in ontology.entity_reasons(e).collect()}
    assert why[("n1", 3)] == "duplicate_id" and why[("n1", 4)] == "placeholder_text" and why[("n1", 0)] is None
    ok = ontology.filter_entities(e)
    told = {x.pos: x.reason for x in ontology.relation_reasons(r, ok).where("node_id = 'n1'").collect()}
    assert told == {0: None, 1: "duplicate_relation", 2: None, 3: "orphan_source", 4: None}
    assert {x.node_id: x.reason for x in ontology.node_reasons(extraction(spark), ok).collect()} == {"n1": None, "n2": None, "n3": "empty_after_filter"}


def test_build(spark):
    registry = spark.createDataFrame([("X.SUBJECT.PERSON", "person")], "concept_id string, label string")
    g = ontology.build(extraction(spark), rule_table(spark, RULES), registry)
    m = {r.mention_id: r for r in g["mentions"].collect()}
    assert m["n1#SUBJECT#1"].status == "CORRECTED" and m["n1#SUBJECT#1"].concept_id == "X.SUBJECT.PERSON"
    assert [r.mention_id for r in g["quarantined_mentions"].collect()] == ["n2#SUBJECT#1"]
    n = g["norms"].collect()
    assert [x.id for x in n] == ["n1#NORM#1"] and n[0].modality == "ALLOW" and n[0].condition_ids == ["n1#CONDITION#1"]
    e = {(r.source, r.type, r.target) for r in g["edges"].collect()}
    assert ("n1#SUBJECT#1", "DENOTES", "X.SUBJECT.PERSON") in e and ("n1#NORM#1", "HAS_ACTION", "n1#ACTION#1") in e
    ref = g["references"].collect()
    assert [(r.scope, r.norm_id) for r in ref] == [("SAME_DOCUMENT", "n1#NORM#1")]
    assert ontology.normative_concept_edges(g["edges"], g["concepts"]).count() == 0
    v = ontology.violations(g["mentions"], g["norms"], g["references"]).first()
    assert tuple(v) == (0, 0, 0, 0)
    assert ontology.unlinked_mentions(g["mentions"], g["edges"], g["norms"], g["references"]).count() >= 0


def test_the_gate_quarantines_and_refuses(spark):
    """A reference that nobody owns leaves with its mention; a graph whose nodes are not there, or that lost rows, is refused."""
    rows = [("n1", [("s", "Người dùng", "SUBJECT", "evidence 1"), ("a", "bán", "ACTION", "evidence 1")], [("s", "ALLOW", "a", "RESOLVED", "evidence 2")]), ("n2", [("r", "khoản 2 Điều 48", "REFERENCE", "evidence 1")], [])]
    x = spark.createDataFrame(rows, EXTRACTION)
    registry = spark.createDataFrame([], "concept_id string, label string")
    g = ontology.build(x, rule_table(spark, RULES), registry)
    assert [r.mention_id for r in g["quarantined_mentions"].collect()] == [r.mention_id for r in g["quarantined_references"].collect()] == ["n2#REFERENCE#1"]
    assert {r.mention_id for r in g["mentions"].collect()} == {"n1#SUBJECT#1", "n1#ACTION#1"} and g["references"].count() == 0
    with pytest.raises(ValueError, match="provenance_violations"):
        ontology.build(x, rule_table(spark, RULES), registry, physical=spark.createDataFrame([("n2",)], "id string"))
    with pytest.raises(ValueError, match="mentions_conserved"):
        ontology.finalize(g, {"mentions": 9})


def test_modality_of_permission_wins(spark):
    e, r = ontology.exploded(extraction(spark))
    assert {x.node_id: x.modality for x in ontology.modality(r, e).collect()} == {"n1": "ALLOW", "n2": "ALLOW"}


def test_cascade(spark):
    n = spark.createDataFrame([("a", ["s"], ["x"], []), ("b", ["s"], ["gone"], [])], "id string, subject_ids array<string>, action_ids array<string>, object_ids array<string>")
    for c in ("condition_ids", "exception_ids", "consequence_ids"):
        n = n.withColumn(c, F.array().cast("array<string>"))
    n = n.withColumns({"norm_completeness": F.lit("COMPLETE"), "subject_status": F.lit("RESOLVED"), "status": F.lit("VALID")})
    kept, lost = ontology.cascade_norms(n, spark.createDataFrame([("s",), ("x",)], "mention_id string"))
    assert [r.id for r in kept.collect()] == ["a"] and [r.id for r in lost.collect()] == ["b"]


def test_trigger_collisions(spark):
    got = {r.trigger for r in trigger_collisions(rule_table(spark, RULES)).collect()}
    assert got == {"người", "hợp đồng"}


def test_taxonomy():
    assert ontology.flatten_taxonomy({"A": {"B": {"C": None}}}) == [("A", ["A"]), ("B", ["A", "B"]), ("C", ["A", "B", "C"])]


def test_small_norm(spark):
    rel = spark.createDataFrame([("n", "node", "S", "A", "PROHIBIT"), ("n", "node", None, "C", "HAS_CONDITION"), ("n", "node", None, "E", "HAS_EXCEPTION"), ("m", "node2", "S", "A", "PROHIBIT"), ("m", "node2", None, "C", "HAS_CONDITION"), ("m", "node2", None, "E", "HAS_EXCEPTION")], "norm_id string, source_node_id string, source string, target string, relation_type string")
    g = fuse.fuse_norms(fuse.norm_contents(rel)).collect()
    assert len(g) == 1 and g[0].id.startswith("GNORM_") and g[0].source_norm_ids == ["m", "n"]
    e = {r.type for r in ontology.norm_edges(fuse.fuse_norms(fuse.norm_contents(rel))).collect()}
    assert e == {"HAS_SUBJECT", "HAS_ACTION", "HAS_CONDITION", "HAS_EXCEPTION"}


def test_adapt_and_fuse(spark):
    norms = spark.createDataFrame([("n#1", "ALLOW", ["m1"], ["m2"], ["m3"], "p1", "VALID"), ("n#2", "ALLOW", [], ["m2"], [], "p2", "VALID")], "id string, modality string, subject_ids array<string>, action_ids array<string>, object_ids array<string>, provenance_node_id string, status string")
    for c in ("condition_ids", "exception_ids", "consequence_ids"):
        norms = norms.withColumn(c, F.array().cast("array<string>"))
    denotes = spark.createDataFrame([("m1", "C1")], "source string, target string")
    edges = spark.createDataFrame([("x", "y", "ALLOW")], "source string, target string, type string")
    rel = fuse.adapt(norms, edges, denotes)
    assert {(r.norm_id, r.source, r.target, r.relation_type) for r in rel.collect()} == {("n#1", "C1", "m2", "ALLOW"), ("n#1", None, "m3", "HAS_OBJECT"), ("n#2", None, "m2", "ALLOW"), (None, "x", "y", "ALLOW")}
    ents = spark.createDataFrame([("C1", "CONCEPT", "p1"), ("m2", "MENTION", "p1"), ("m3", "MENTION", "p1"), ("unused", "MENTION", "p1")], "id string, fusion_kind string, node_id string")
    out = fuse.fuse(spark.createDataFrame([("p1",), ("p2",)], "id string"), ents, rel, norms)
    assert "unused" not in {r.id for r in out["entities"].collect()}
    assert {(r.source, r.target) for r in out["rejected_edges"].collect()} == {("x", "y")}


def test_conflict_reviews(spark):
    n = spark.createDataFrame([("a", "ALLOW", ["c"]), ("p", "PROHIBIT", ["c"]), ("q", "PROHIBIT", ["d"])], "id string, modality string, condition_ids array<string>")
    n = n.withColumns({"subject_ids": F.array(F.lit("s")), "action_ids": F.array(F.lit("x")), "exception_ids": F.array().cast("array<string>"), "object_ids": F.array().cast("array<string>")})
    texts = spark.createDataFrame([("c", "Có đất"), ("d", "pháp luật không cho phép")], "id string, canonical_text string")
    found = fuse.conflicts(n, texts)
    assert {(r.prohibit_id, r.flag) for r in found.collect()} == {("p", "POTENTIAL_LEGAL_CONFLICT"), ("q", "REVIEW_REQUIRED")}
    rn, re_ = fuse.reviews(found)
    assert sorted(r.id for r in rn.collect()) == ["REVIEW_001", "REVIEW_002"] and re_.count() == 8


def test_conflict_classes_count_all_pairs(spark):
    """Against the pairs themselves: marks, equal and unequal conditions, repeated and null parts, a hot key."""
    rng = random.Random(5)
    words = ["c", "d", "free", "fee", "barred", None]
    pick = lambda k: [rng.choice(words) for _ in range(rng.randint(0, k))]
    rows = [(str(i), rng.choice(["ALLOW", "REQUIRE", "PROHIBIT", "OTHER", None]), rng.choice([["s"], ["s", "t"], ["s"], ["u", "u"], [], None, [None]]), rng.choice([["x"], ["x"], ["x", "y"]]), pick(2), rng.choice([[], [], [], ["e"], None]), rng.choice([["o"], ["p"], ["p", "o"], None])) for i in range(600)]
    n = spark.createDataFrame(rows, "id string, modality string, subject_ids array<string>, action_ids array<string>, condition_ids array<string>, exception_ids array<string>, object_ids array<string>")
    texts = spark.createDataFrame([("c", "Có đất"), ("free", "không thu tiền sử dụng đất"), ("fee", "có thu tiền sử dụng đất"), ("barred", "pháp luật không cho phép")], "id string, canonical_text string")
    for t in (texts, None):
        pairs = fuse.conflicts(n, t)
        want = Counter((r.subject, r.action, r.conflict_type, r.flag, r.context_status) for r in pairs.collect())
        got = {(r.subject, r.action, r.conflict_type, r.flag, r.context_status): r.n_pairs for r in fuse.conflict_classes(n, t).collect()}
        assert got == dict(want) and sum(want.values()) > 5000
        assert {(r.subject, r.action, r.id) for r in fuse.conflict_members(n, t).collect()} == {(r.subject, r.action, i) for r in pairs.collect() for i in (r.positive_id, r.prohibit_id)}
    assert fuse.conflict_classes(n.where("false"), texts).count() == fuse.conflict_members(n.where("false")).count() == 0


def test_pairs_of_a_hot_key_are_dealt_in_blocks(spark):
    a = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), F.col("id").alias("x"))
    b = spark.range(1500).select(F.when(F.col("id") % 2 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), F.col("id").alias("y"))
    got = fuse.paired(a, b, ("k",), block=100)
    plain = a.join(b, "k")
    sums = lambda df: df.agg(F.count("*"), F.count_distinct("x", "y"), F.sum(F.col("x") * F.col("y"))).first()
    assert sums(got) == sums(plain)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        spread, alone = most(fuse.paired(a, b, ("k",), block=100)), most(plain)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spread <= 2 * sums(plain)[0] / 4 and alone > 0.9 * sums(plain)[0]


def test_references(spark):
    nodes = spark.createDataFrame([("n1", "L", "46", "1", None), ("n2", "L", "46", None, None), ("n3", "L", "7", None, None), ("n4", "L", "7", None, None)], "id string, law_code string, article string, clause string, point string")
    refs = spark.createDataFrame([("r1", "L", "src", "khoản 1 Điều 46"), ("r2", "L", "src", "Điều 7"), ("r3", "L", "src", "điều này"), ("r4", "L", "src", "không rõ")], "ref_id string, law_code string, source_node_id string, text string")
    closure = spark.createDataFrame([("src", "ARTICLE", "n2")], "id string, label string, ancestor string")
    got = {r.ref_id: (r.targets, r.status) for r in fuse.resolve(refs, nodes, closure).collect()}
    assert got == {"r1": (["n1"], "RESOLVED_TEXT"), "r2": ([], "AMBIGUOUS_OR_MISSING"), "r3": (["n2"], "RESOLVED_ANAPHORIC"), "r4": ([], "UNRESOLVED")}


def test_delta_contract():
    with pytest.raises(ValueError):
        fuse.checked_delta({"added_nodes": None})


PLACES = [
    ("l", None, "LAW", None), ("c1", "l", "CHAPTER", "I"), ("c2", "l", "CHAPTER", "II"), ("s1", "c2", "SECTION", "1"), ("s2", "c2", "SECTION", "2"),
    ("a5", "c1", "ARTICLE", "5"), ("a6", "s1", "ARTICLE", "6"), ("a7", "c1", "ARTICLE", "7"), ("a7b", "c1", "ARTICLE", "7"),
    ("a5k1", "a5", "CLAUSE", "1"), ("a5k2", "a5", "CLAUSE", "2"), ("a5k2p", "a5k2", "POINT", "a"), ("a6k1", "a6", "CLAUSE", "1"),
]


def test_references_of_all_kinds(spark):
    nodes = spark.createDataFrame([(*p, "31/2024/qh15") for p in PLACES] + [("x5", None, "ARTICLE", "5", "1/2020/nd")], "id string, parent_id string, label string, number string, law_code string")
    titles = spark.createDataFrame([("31/2024/qh15", ["dat", "dai"])], "law_code string, title_tokens array<string>")
    none = (None, None, None, None, None)
    rows = {
        "two articles": ("a5k1", "Điều 5 và Điều 6", *none, ["a5", "a6"], "RESOLVED"),
        "foreign statute": ("a5k1", "theo Điều 5 Luật Đầu tư", *none, [], "TARGET_NOT_FOUND"),
        "own title": ("a5k1", "Điều 5 Luật Đất đai", *none, ["a5"], "RESOLVED"),
        "own act": ("a5k1", "Điều 5 Luật này", *none, ["a5"], "RESOLVED"),
        "own code": ("a5k1", "Điều 5 của 31/2024/QH15", *none, ["a5"], "RESOLVED"),
        "foreign code": ("a5k1", "Điều 5 của 45/2013/QH13", *none, [], "TARGET_NOT_FOUND"),
        "compound": ("a6k1", "khoản 2 Điều 5 và Điều 6", *none, ["a5k2", "a6"], "RESOLVED"),
        "section of a chapter": ("a6k1", "Mục 2 Chương II, Chương I", *none, ["s2", "c1"], "RESOLVED"),
        "not unique": ("a6k1", "Điều 7", *none, [], "TARGET_NOT_FOUND"),
        "this clause": ("a5k2p", "khoản này", *none, ["a5k2"], "RESOLVED"),
        "clause of this article": ("a5k2p", "khoản 1 Điều này", *none, ["a5k1"], "RESOLVED"),
        "section of this chapter": ("a6k1", "mục 2 chương này", *none, ["s2"], "RESOLVED"),
        "this section": ("a6k1", "mục này", *none, ["s1"], "RESOLVED"),
        "hint same": ("a5k2p", "x", None, "same", "1", None, None, ["a5k1"], "RESOLVED"),
        "hint articles": ("a5k2p", "x", "SAME_DOCUMENT", "7", None, None, None, ["a7", "a7b"], "RESOLVED"),
        "hint section": ("a5k2p", "x", None, None, None, "1", "ii", ["s1"], "RESOLVED"),
        "hint before text": ("a5k2p", "Điều 6", None, "5", "2", None, None, ["a5k2"], "RESOLVED"),
        "external": ("a5k2p", "Điều 5", "EXTERNAL", None, None, None, None, [], "OUT_OF_SCOPE"),
        "ambiguous": ("a5k2p", "Điều 5", "ambiguous", None, None, None, None, [], "AMBIGUOUS"),
        "other scope": ("a5k2p", "Điều 5", "ELSEWHERE", None, None, None, None, [], "NOT_ATTEMPTED"),
        "no source": ("gone", "Điều 5", *none, [], "TARGET_NOT_FOUND"),
        "no text": ("a5k1", None, *none, [], "TARGET_NOT_FOUND"),
    }
    refs = spark.createDataFrame([(k, *v[:7]) for k, v in rows.items()], "ref_id string, source_node_id string, text string, scope string, hint_article string, hint_clause string, hint_section string, hint_chapter string")
    got = {r.ref_id: (r.targets, r.status) for r in references.resolve(refs, nodes, titles).collect()}
    assert got == {k: v[7:] for k, v in rows.items()}
    assert references.resolve(refs.where("false"), nodes, titles).count() == 0


def _by_tables(extractions, rules, registry):
    """The build by the operators on tables, each for all nodes."""
    e, r = ontology.exploded(extractions)
    entities = ontology.filter_entities(e).localCheckpoint()
    rejected = ontology.node_reasons(extractions, entities).where("reason is not null").localCheckpoint()
    entities = entities.join(rejected.select("node_id"), "node_id", "left_anti")
    relations = ontology.filter_relations(r, entities).localCheckpoint()
    mentions = ontology.normalize_entities(entities, rules)
    mentions, links = ontology.gate(mentions, ontology.normalize_relations(relations, entities, mentions), ["việc này", "điều này", "nội dung này"])
    mentions, links = mentions.localCheckpoint(), links.localCheckpoint()
    norms = ontology.build_norms(mentions, links, ontology.modality(relations, entities)).localCheckpoint()
    active = mentions.where("status <> 'QUARANTINED'")
    concepts = ontology.concepts_used(active, registry)
    before = {"mentions": mentions.count(), "norms": norms.count()}
    norms, lost = (n.localCheckpoint() for n in ontology.cascade_norms(norms, active))
    edges = ontology.denotes(active).unionByName(ontology.norm_edges(norms)).unionByName(ontology.simple_edges(links, norms)).distinct()
    told = ontology.edge_reasons(edges, active, norms, concepts).localCheckpoint()
    references = ontology.repair_owners(ontology.classify_references(active, norms), norms, active).localCheckpoint()
    graph = {
        "mentions": active, "concepts": concepts, "norms": norms, "references": references.where("status = 'VALID'"), "edges": told.where("reason is null").drop("reason"), "rejected_nodes": rejected,
        "quarantined_mentions": mentions.where("status = 'QUARANTINED'"), "quarantined_norms": lost, "quarantined_edges": told.where("reason is not null"), "quarantined_references": references.where("status <> 'VALID'"),
    }
    return ontology.finalize(graph, before)


def test_a_node_is_built_from_its_own_row(spark):
    """Random extractions with all faults: the build gives what the operators on tables give, and moves no row before it is done."""
    import random
    import unicodedata

    rng = random.Random(4)
    texts = ["Người dùng", "hợp đồng", unicodedata.normalize("NFD", "Người thuê"), "Việc  này", "N/A", "Không có", None, "bán", "khoản 2 Điều 48", "Luật X", "điều này", " bán "]
    proofs = ["evidence 1", "ev 2", "--", "", None, unicodedata.normalize("NFD", "chứng cứ"), "n/a"]
    kinds = [*ontology.ENTITY_TYPES, *ontology.ENTITY_TYPES, " subject ", "Action", "OTHER", None]
    types = ["ALLOW", "REQUIRE", "PROHIBIT", "HAS_OBJECT", "HAS_CONDITION", "HAS_EXCEPTION", "HAS_PENALTY", "APPLY_TO", "REFERENCE_TO", "allow", "", None]
    ids = ["a", "b", "c", "d", "e", " ", None]
    pick = lambda xs: rng.choice(xs)
    rows = [("n%d" % n, [(pick(ids), pick(texts), pick(kinds), pick(proofs[:2] + proofs)) for _ in range(rng.randrange(7))], [(pick(ids), pick(types), pick(ids[:5]), pick(["RESOLVED", "UNRESOLVED", None]), pick(proofs[:2] + proofs)) for _ in range(rng.randrange(8))]) for n in range(400)]
    rows += [("m%d" % n, [("r", "khoản 2 Điều 48", "REFERENCE", "ev 1"), ("s", "hợp đồng", "SUBJECT", "ev 1")][: 1 + n % 2], None if n % 3 else [("r", "HAS_OBJECT", "r", None, "ev 1")]) for n in range(6)] + [("", [], []), ("none", None, None)]
    x = spark.createDataFrame(rows, EXTRACTION)
    registry = spark.createDataFrame([("X.SUBJECT.PERSON", "person")], "concept_id string, label string")
    plan = ontology._built(x, rule_table(spark, RULES), ["việc này"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan
    got, want = ontology.build(x, rule_table(spark, RULES), registry), _by_tables(x, rule_table(spark, RULES), registry)
    for name in ("mentions", "quarantined_mentions", "norms", "quarantined_norms", "edges", "quarantined_edges", "references", "quarantined_references", "rejected_nodes", "concepts", "report"):
        columns = sorted(set(want[name].columns))
        a, b = (sorted(repr(tuple(r)) for r in g[name].select(columns).collect()) for g in (got, want))
        assert a == b, name
        assert a or name == "concepts", name


def test_texts_told_to_be_nfc_are(spark):
    """No character that keeps a text from Python changes by NFC, is a mark, or goes together with one before it."""
    import unicodedata

    from lexigrove.functions import text as T

    pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
    second = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    chars = spark.createDataFrame([(i, chr(i)) for i in range(0xD800)], "i int, c string")
    told = {r.i for r in chars.where(F.col("c").rlike(T.NFC_ALREADY)).select("i").collect()}
    assert len(told) >= 1000
    assert not [i for i in told if unicodedata.normalize("NFC", chr(i)) != chr(i) or unicodedata.combining(chr(i)) or i in second]
