import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove import services
from lexigrove.operators import retrieve, route, stats


def test_reference_goldens():
    got = retrieve.reference_locators("điều kiện quy định tại điểm đ khoản 1 Điều 46", "LD2024:A45")
    assert got == [("LD2024:A46:K1:Dđ", "REQUIRES_CONDITION_FROM")]
    got = retrieve.reference_locators("có quyền và nghĩa vụ tại Điều 26 và Điều 31", "LD2024:A33")
    assert got == [("LD2024:A26", "INHERITS_RIGHTS_OBLIGATIONS"), ("LD2024:A31", "INHERITS_RIGHTS_OBLIGATIONS")]
    assert retrieve.reference_locators("khoản 1 và khoản 2 Điều 99; khoản 3 Điều này; điểm a khoản này", "LD2024:A30:K5") == [("LD2024:A99:K1", "EXTERNAL_REFERENCE"), ("LD2024:A99:K2", "EXTERNAL_REFERENCE"), ("LD2024:A30:K3", "DIRECT_REFERENCE"), ("LD2024:A30:K5:Da", "DIRECT_REFERENCE")]
    assert retrieve.reference_locators("Điều 30", "LD2024:A30") == [] and retrieve.reference_locators("", None) == []


GRAPH = [
    ("law_dieu-30_p0", "ARTICLE", None, 1, "Cho thuê", "Quyền cho thuê", 0),
    ("law_dieu-30_khoan-1_p1", "CLAUSE", "law_dieu-30_p0", 1, None, "Người thuê đất được cho thuê lại khi có đủ điều kiện quy định tại khoản 1 Điều 45", 1),
    ("law_dieu-30_khoan-2_p2", "CLAUSE", "law_dieu-30_p0", 2, None, "Không được cho thuê lại, trừ trường hợp khác", 2),
    ("law_dieu-45_p3", "ARTICLE", None, 2, "Điều kiện", "Điều kiện chung", 3),
    ("law_dieu-45_khoan-1_p4", "CLAUSE", "law_dieu-45_p3", 1, None, "Điều kiện: phải có giấy chứng nhận; theo Điều 99", 4),
]


def graph(spark):
    return spark.createDataFrame(GRAPH, "id string, type string, parent_id string, position int, title string, text string, start_idx int")


def test_typed_paths_and_pruning(spark):
    n = graph(spark)
    refs = retrieve.reference_edges(n)
    one = retrieve.typed_paths(n, refs, ["law_dieu-30_p0"], 1).collect()
    assert [(r.source_locator, r.target_locator, r.target_id) for r in one] == [("LD2024:A30:K1", "LD2024:A45:K1", "law_dieu-45_khoan-1_p4")]
    two = retrieve.typed_paths(n, refs, ["law_dieu-30_p0"], 2)
    assert [(r.hop, r.target_id.startswith("external:")) for r in two.collect()] == [(1, False), (2, True)]
    kept = retrieve.prune_paths("điều kiện cho thuê lại", two, ["LD2024:A30"], keep=1).collect()
    assert [r.target_locator for r in kept] == ["LD2024:A45:K1"]
    with pytest.raises(ValueError):
        retrieve.typed_paths(n, refs, ["a"], 3)
    with pytest.raises(ValueError):
        retrieve.distinct_ids(["a", " "])
    with pytest.raises(ValueError):
        retrieve.neighbourhood(refs, ["a"], 4)


def test_hierarchy(spark):
    n = graph(spark)
    assert [r.id for r in retrieve.parents(n, ["law_dieu-30_khoan-1_p1"]).collect()] == ["law_dieu-30_p0"]
    assert [r.position for r in retrieve.children(n, ["law_dieu-30_p0"]).collect()] == [1, 2]
    assert retrieve.below(n, ["law_dieu-30_p0"]).count() == 2
    assert [r.id for r in retrieve.exceptions(n, ["law_dieu-30_p0"]).collect()] == ["law_dieu-30_khoan-2_p2"]
    assert [r.id for r in retrieve.physical(n, ["law_dieu-45_p3", "law_dieu-30_p0"]).collect()] == ["law_dieu-45_p3", "law_dieu-30_p0"]


def test_children_facets_policy(spark):
    kids = graph(spark).where("parent_id is not null").select(F.col("id").alias("node_id"), F.lit("LD2024:A30").alias("parent_locator"), "position", "text")
    got = retrieve.select_children("điều kiện để cho thuê lại", kids, ["LD2024:A30"]).collect()
    assert len(got) >= 1 and all(r.score >= 0.25 for r in got)
    assert len(retrieve.select_children("xyz", kids, ["LD2024:A30"]).collect()) == 1
    assert retrieve.requested_facets("các điều kiện bao gồm những gì") == {"CONDITION", "LIST"}
    q = spark.createDataFrame([("so sánh các điều kiện, ai được?",)], "q string").select(retrieve.signals_of("q").alias("s"))
    assert q.first().s == ["LIST_REQUEST", "SUBJECT_REQUEST", "COMPARISON_REQUEST"]
    f = q.select(retrieve.features_of(F.col("s")).alias("f"))
    assert set(f.first().f) == {"requires_all_children", "requires_subject_resolution", "requires_parent_context", "requires_comparison"}
    p = f.select(retrieve.policy(F.col("f"), F.create_map(F.lit("requires_exception"), F.lit(0.5), F.lit("requires_reference_traversal"), F.lit(0.36))).alias("p")).first().p
    assert "requires_exception" in p.activated and p.uncertain == ["requires_exception"] and "requires_reference_traversal" in p.activated and "requires_multi_hop" not in p.activated


def test_rank_gate_budget(spark):
    c = spark.createDataFrame(
        [("a", "LD2024:A30", "cho thuê đất", "CHILD", None, 0, None, ["CHILD"], None, None, True), ("b", "LD2024:A30", "Cho  thuê đất", "NORM", 0.9, 0, None, ["A", "B", "C", "D"], None, None, True), ("d", "LD2024:A31:K1", "khác", "ANCHOR", 0.1, 1, "X", ["ANCHOR"], None, None, True)],
        retrieve.CANDIDATE,
    )
    r = retrieve.rank("cho thuê đất", c)
    assert [(x.node_id, x.rank_score) for x in r.collect()] == [("b", 0.8), ("d", 0.385)]
    relevance = lambda *x: spark.createDataFrame(list(x), "node_id string, relevance double")
    assert [x.node_id for x in retrieve.gate(r, relevance(("b", 0.5), ("d", 0.1))).collect()] == ["b"]
    assert [x.node_id for x in retrieve.gate(r, relevance(("b", 0.1), ("d", 0.2))).collect()] == ["d"]
    one = retrieve.assemble(r, 10_000).first()
    assert one.included_count == 2 and one.context.startswith("Bằng chứng 1 [LD2024:A30]")
    assert retrieve.assemble(r, 1).first().context == retrieve.NO_EVIDENCE
    costs = spark.createDataFrame([([30, 5, 50, 10, 20],), ([],)], "c array<int>")
    assert [x[0] for x in costs.select(retrieve.within_budget(F.col("c"), 60)).collect()] == [[0, 1, 3], []]
    assert retrieve.missing_facets({"context_has_subject": 0.9, "context_is_sufficient": 0.7}) == ["conditions", "exception", "reference_target"]


def test_answer_context(spark):
    n = graph(spark)
    encoder = services.hashing_encoder()
    v = services.encoded(n.withColumn("text", F.coalesce("text", "title")), encoder, "id")
    out = retrieve.answer_context("điều kiện cho thuê lại", n, v, encoder(["điều kiện cho thuê lại"])[0])
    assert out["context"].first().included_count > 0 and out["anchors"].count() > 0


def test_the_budget_decides_what_follows(spark, sf):
    """What the budget leaves out of a context is neither in its sections nor in its hierarchy."""
    from lexigrove.plans.queries import QUERIES

    n = graph(spark)
    encoder = services.hashing_encoder()
    v = services.encoded(n.withColumn("text", F.coalesce("text", "title")), encoder, "id")
    question = "liệt kê các điều kiện cho thuê lại theo Điều 45"
    sizes = []
    for budget in (10_000, 120):
        out = retrieve.answer_context(question, n, v, encoder([question])[0], budget=budget)
        every, context = out["included"].collect(), out["context"].first()
        inside = sorted((r for r in every if r.number), key=lambda r: r.number)
        assert len(every) == context.candidate_count == out["evidence"].count() and len(inside) == context.included_count
        assert "\n\n".join(r.section for r in inside) == context.context and sum(r.estimated_tokens for r in inside) == context.estimated_tokens <= budget
        assert all(r.section is None for r in every if not r.number)
        ids = {r.node_id for r in inside}
        assert all(r.id in ids and r.parent_id in ids for r in out["hierarchy"].collect())
        sizes.append(len(inside))
    assert sizes[0] > sizes[1] > 0
    rows = QUERIES["question_context"](spark, sf).collect()
    assert rows and any((r.section or "").startswith("Bằng chứng 1 [") for r in rows)


def test_services(spark):
    calls, slept = [], []

    def fails(x):
        calls.append(x)
        raise RuntimeError("down")

    assert services.with_retries(fails, fallback=lambda e: "empty", sleep=slept.append)("q") == "empty" and len(calls) == 3 and slept == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        services.with_retries(fails, sleep=slept.append)("q")
    assert services.parse_decision('{"answers": {"a": 0.5}}', ["a"]) == {"a": 0.5}
    for bad in ('{"answers": {"a": 2}}', '{"answers": {"b": 0.5}}'):
        with pytest.raises(ValueError):
            services.parse_decision(bad, ["a"])
    with pytest.raises(ValueError):
        services.answer("q", "c", lambda q, c: " ")
    n = graph(spark)
    routes = n.select(F.col("id").alias("node_id"), F.lit("LLM_CANDIDATE").alias("route"))
    got = services.extracted(n, routes, lambda p: {"entities": [{"id": "e", "text": p[-5:], "entity_type": "SUBJECT", "evidence": "x"}], "relations": []}, limit=2).collect()
    assert len(got) == 2 and got[0].entities[0].id == "e"
    p = {r.node_id: r.prompt for r in services.prompts(n).collect()}
    assert "- ARTICLE: Cho thuê - Quyền cho thuê" in p["law_dieu-30_khoan-1_p1"]


def pav(pairs):
    blocks = []
    for s in sorted({s for s, _ in pairs}):
        y = [v for t, v in pairs if t == s]
        blocks.append([s, sum(y), len(y)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            s2, p, n = blocks.pop()
            blocks[-1] = [s2, blocks[-1][1] + p, blocks[-1][2] + n]
    return [(s, p / n) for s, p, n in blocks]


def test_isotonic(spark):
    rng = np.random.default_rng(0)
    pairs = [(round(float(x), 1), int(rng.random() < x)) for x in rng.random(80)]
    df = spark.createDataFrame(pairs, "score double, label int")
    fit = stats.isotonic_fit(df)
    got = sorted((r.threshold, r.value) for r in fit.collect())
    want = pav(pairs)
    at = lambda blocks, s: next((v for t, v in blocks if s <= t), blocks[-1][1])
    for s in sorted({s for s, _ in pairs}):
        assert at(got, s) == pytest.approx(at(want, s))
    p = stats.isotonic_predict(spark.createDataFrame([(0.0,), (2.0,)], "score double"), fit).collect()
    assert p[0].calibrated == pytest.approx(want[0][1]) and p[1].calibrated == pytest.approx(want[-1][1])


def _pav_of_counts(frame):
    """Blocks (threshold, value) of counts (threshold, pos, n) by the stack, all in one place."""
    blocks = []
    for t, p, n in frame.sort_values("threshold").itertuples(index=False):
        blocks.append([t, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] > blocks[-1][1] * blocks[-2][2]:
            t2, p2, n2 = blocks.pop()
            blocks[-1] = [t2, blocks[-1][1] + p2, blocks[-1][2] + n2]
    return [(t, p / n) for t, p, n in blocks]


@pytest.mark.parametrize("shape", ["clean", "noisy", "falling", "saw"])
def test_isotonic_ranges_are_joined(spark, shape):
    """A million distinct scores (clean ones pool nothing into few blocks) equal the fit in one place."""
    n = 1_000_000 if shape == "noisy" else 20_000
    i = F.col("id")
    chance = F.pmod(F.xxhash64(i), F.lit(1000)) / 1000.0
    label = {"clean": (i * 2 > n), "noisy": chance < i / n, "falling": i * 2 < n, "saw": chance < (i % 3000) / 3000.0}[shape].cast("int")
    rows = spark.range(n).select((i / n).alias("score"), label.alias("label"))
    more = rows.where("score < 0.3").select("score", F.lit(1).alias("label"))
    rows = rows.unionByName(more) if shape == "saw" else rows
    got = sorted((r.threshold, r.value) for r in stats.isotonic_fit(rows, ranges=None if shape == "noisy" else 13).collect())
    counts = rows.groupBy(F.col("score").alias("threshold")).agg(F.sum("label").cast("double").alias("pos"), F.count("*").cast("double").alias("n")).toPandas()
    want = _pav_of_counts(counts)
    step = lambda blocks: [b for b, after in zip(blocks, [*blocks[1:], (None, None)]) if b[1] != after[1]]  # noqa: E731  equal neighbours are one step
    got, want = step(got), step(want)
    assert [t for t, _ in got] == [t for t, _ in want]
    assert np.allclose([v for _, v in got], [v for _, v in want], atol=1e-12)


def test_isotonic_without_rows_and_with_nulls(spark):
    schema = "score double, label int"
    assert stats.isotonic_fit(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in stats.isotonic_fit(spark.createDataFrame([(0.5, 1), (None, 0), (0.2, None)], schema)).collect()] == [(0.5, 1.0, 1)]


def test_statistics(spark):
    c = stats.confidence(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.1, 0), (1.4, 1)], "score double, label int")).first()
    assert (c["count"], c.brier_score, c.precision_at_threshold, c.recall_at_threshold) == (4, 0.165, 0.66666667, 1.0)
    e = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "expected string, predicted string")
    m = stats.classification(e, "a").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 0, 1, 1) and stats.classification(e).first().mismatches == 1
    gold = spark.createDataFrame([(1, "x", "x", None), (2, None, "y", "y"), (2, None, "y", "y")], "case_id int, expected string, predicted string, annotation string")
    assert sorted((r.case_id, r.expected) for r in stats.adjudicated(gold).collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="no agreed value"):
        stats.adjudicated(gold.unionByName(spark.createDataFrame([(3, None, "y", None)], gold.schema))).collect()
    k = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "x")], "case_id int, reviewer string, label string")
    assert stats.mean_kappa(k).first().kappa == 1.0


def test_routing(spark):
    n = spark.createDataFrame([("1", "CHAPTER", "theo quy định tại"), ("2", "CLAUSE", "abc"), ("3", "CLAUSE", "trừ khi có căn cứ"), ("4", "CLAUSE", "điều kiện là đây"), ("5", "CLAUSE", "không có gì cả"), ("6", "CLAUSE", None)], "node_id string, type string, text string")
    got = {r.node_id: (r.route, r.reason) for r in route.route(n).collect()}
    assert got == {"1": ("RULE_ONLY", "STRUCTURAL_NODE"), "2": ("REJECT", "EMPTY_NODE"), "3": ("LLM_CANDIDATE", "CROSS_REF"), "4": ("REJECT", "LOW_CONFIDENCE_CONDITION"), "5": ("REJECT", "NO_TRIGGER"), "6": ("REJECT", "EMPTY_NODE")}
    s = spark.createDataFrame([("5", 0.9)], "node_id string, embed_score double")
    assert route.route(n, s).where("node_id = '5'").first().route == "LLM_CANDIDATE"
    assert route.route(n, s, "EXP-A").where("node_id = '5'").first().route == "REJECT"
    v = spark.createDataFrame([([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in v.select(route.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    one = route.content_hash(n, "text", "node_id")
    assert one == route.content_hash(n.repartition(5), "text", "node_id") and one != route.content_hash(n.limit(3), "text", "node_id")


def test_cached(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for key in ("a", "a", "b"):
        assert route.cached(str(tmp_path / "c"), key, make, spark).count() == 3
    assert len(made) == 2


def test_recovery(spark):
    c = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    q = stats.recovery_quality(c, spark.createDataFrame([("a",), ("c",)], "text string")).first()
    assert (q.tp, round(q.precision, 4), q.recall) == (1, 0.3333, 0.5)
    p = spark.createDataFrame([("d", 0, "Điều 1"), ("d", 1, "mở đầu"), ("d", 2, "a) một"), ("d", 3, "b) hai"), ("d", 4, "")], "doc string, idx int, text string")
    art = spark.createDataFrame([("d", "x", 0, 5)], "doc string, article_id string, start_idx int, end_idx int")
    assert [r.idx for r in stats.clause_candidates(p, art, "H1").collect()] == [1]
    assert stats.clause_candidates(p, art, "H2").count() == 3
    assert [r.idx for r in stats.clause_candidates(p, art, "H3").collect()] == [1]


def test_the_whole_answer(spark):
    """Routing, gate, one expansion, answer paths and forced evidence; a service that fails is as none."""
    n = graph(spark)
    encoder = services.hashing_encoder()
    v = services.encoded(n.withColumn("text", F.coalesce("text", "title")), encoder, "id")
    question = "liệt kê các điều kiện cho thuê lại theo Điều 45"
    ask = lambda **how: retrieve.answer_context(question, n, v, encoder([question])[0], **how)
    plain = ask()
    assert plain["route"]["routing_source"] == "RULES_AND_FALLBACK" and {"requires_all_children", "requires_reference_traversal"} <= set(plain["route"]["activated"])
    assert plain["gate"] == "NOT_CONFIGURED" and plain["expansions"] == []
    fails = lambda *x: 1 / 0
    same = ask(service=fails, judge=fails)
    assert same["gate"] == "FAILED_FALLBACK_USED" and same["route"] == plain["route"]
    assert same["context"].first() == plain["context"].first()
    sure = lambda q, r: (r.select("node_id", F.lit(0.9).alias("relevance")), {})
    grown = ask(service=lambda q, s: {"requires_multi_hop": 0.9, "requires_exception": 0.5}, judge=sure)
    assert grown["expansions"] == ["PARENT_CONTEXT", "CHILDREN", "REFERENCE_PATHS", "EXCEPTION_CONTEXT"] and grown["gate"] == "OK"
    assert grown["route"]["uncertain"] == ["requires_exception"] and "overall_sufficiency" in grown["missing"]
    for out in (plain, grown):
        ids = [(r.canonical_locator, r.text) for r in out["evidence"].collect()]
        assert ids and len(ids) == len(set(ids))
        assert {s[0] for p in out["answer_paths"] for s in p["steps"]} <= {i for i, _ in ids}


def test_rebuilt_paths(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "d"), ("e", "f")], "source_locator string, target_locator string")
    some = spark.createDataFrame([(i,) for i in "abcxde"], "locator string")
    got = sorted((r.start, "".join(r.places), r.n) for r in retrieve.rebuilt_paths(refs, some).collect())
    assert got == [("x", "xabc", 3), ("x", "xd", 1)]
