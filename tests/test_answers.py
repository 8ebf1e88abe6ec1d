"""Question profiles, the fit of texts and paths of proof, on single cases and against a plain walk."""

import random

from pyspark.sql import functions as F

from lexigrove.operators import answers
from lexigrove.operators.retrieve import folded


def fits(spark, question, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    q, d = answers.profile(F.lit(question)), answers.described("text")
    return [round(r.s, 6) for r in rows.select(answers.fit(q, d).alias("s")).collect()]


def told(spark, question):
    return spark.range(1).select(answers.profile(F.lit(question)).alias("q")).first().q


def test_profile(spark):
    q = told(spark, "Doanh nghiệp có vốn đầu tư nước ngoài thuê lại đất trong khu công nghiệp muốn bán tài sản, chuyển nhượng. Điều kiện?")
    assert set(q.actions) == {"ban tai san", "chuyen nhuong", "chuyen doi"}  # what follows the cue, not all that is named; a token of "chuyen doi" does not count
    assert set(q.subject) == {folded("vốn đầu tư nước ngoài"), folded("doanh nghiệp có vốn đầu tư nước ngoài")}
    assert set(q.legal_regime) == {folded("thuê lại đất"), folded("khu công nghiệp")}
    assert set(q.concepts) == {"economic_organization", "foreign_invested_entity", "industrial_zone"}
    assert "CONDITION" in q.facets and not q.lease and folded("khu công nghiệp") in q.known
    q = told(spark, "Xác định quyền bán tài sản cùng quyền thuê trong hợp đồng thuê đất; đăng ký")
    assert "RIGHT_ORIGIN" in q.facets and q.lease and "dang ky" in q.actions
    q = told(spark, "")
    assert (q.tokens, q.actions, q.subject, q.concepts, q.facets, q.lease) == ([], [], [], [], [], False)
    assert told(spark, None).tokens == []


def test_fit(spark):
    question = "tổ chức kinh tế thế chấp"
    # tokens chuc, kinh, the, chap; the action's are the, chap; a role and a concept
    assert fits(spark, question, "tổ chức kinh tế được thế chấp", "thế chấp", "thế chấp trong khu công nghiệp", "", None) == [1.0, 0.395, 0.295, 0.0, 0.0]
    regimes = "vốn đầu tư nước ngoài khu công nghiệp cụm công nghiệp khu công nghệ cao"
    assert fits(spark, "thế chấp", f"thế chấp {regimes}") == [0.5]  # the penalty of regimes ends at 0.30
    assert fits(spark, "trả tiền thuê đất hằng năm", "nộp tiền hằng năm", "trả tiền")[1] < 0.3


def brute(edges, kids, roots=12, most=6, depth=6):
    """The walk over scored edges (source, type, target, score) and children {parent: [(child, value)]} that neither act nor hold conditions."""
    out = {}
    for e in edges:
        out.setdefault(e[0], []).append(e)
    for es in out.values():
        es.sort(key=lambda e: -e[3])
    done = []

    def walk(node, steps, score, seen, n):
        onward = [e for e in out.get(node, []) if e[2] not in seen][:2] if n < depth else []
        moves = [(e[2], e[1], e[3]) for e in onward]
        if n < depth and not onward:
            ranked = sorted((c for c in kids.get(node, []) if c[0] not in seen), key=lambda c: -c[1])
            moves = [(c, "PARENT_CHILD_CONTEXT", v) for c, v in ranked if v >= 0.22][:2]
        if not moves:
            done.append((score, steps))
        for to, kind, v in moves:
            walk(to, [*steps, (node, kind, to)], score + v, seen | {to}, n + 1)

    starts = sorted((e for e in edges if e[3] > 0), key=lambda e: -e[3])[:roots]
    for s, kind, t, score in starts:
        before = len(done)
        walk(t, [(s, kind, t)], score, {s, t}, 1)
        done[before:] = [(total, steps, score) for total, steps in done[before:]]
    best = {}
    for total, steps, root in done:
        if total > best.get(tuple(steps), (-1, 0))[0]:
            best[tuple(steps)] = total, root
    whole = {k: v for k, v in best.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in best)}
    rank = lambda k: 0.7 * whole[k][1] + 0.3 * (whole[k][0] - whole[k][1]) / max(1, len(k) - 1)
    ranked = sorted(whole, key=lambda k: (-round(rank(k), 9), -len(k)))
    return [list(k) for k in ranked if k[0] == ranked[0][0]][:most]


def test_paths_of_many_questions(spark, seed=1):
    """Random graphs with cycles and dead ends; scores come from the words that texts share with the question."""
    r = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + i)}x" for i in range(8)]
    asked, edges, kids, want = [], [], [], {}
    for q in range(12):
        mine = r.sample(words, 4)
        asked.append((q, " ".join(mine), False))
        text = lambda: " ".join(r.sample(words, r.randrange(1, 6)))  # noqa: B023, E731
        places = [f"LD2024:A{i}" for i in range(1, 9)]
        said = {p: text() for p in places} | {f"{p}:K{k}": text() for p in places for k in (1, 2, 3)}
        fit = lambda t: 0.45 * len(set(t.split()) & set(mine)) / len(mine)  # noqa: B023, E731
        own, pairs = [], set()
        for i in range(14):
            s, t = r.choice(list(said)), r.choice(places)
            if s == t or (s, t) in pairs:
                continue
            pairs.add((s, t))
            score = round(0.5 * (0.4 * fit(said[s]) + 0.6 * fit(said[t])) + 0.15 * 0.25 + 0.025 * (":K" in s), 6)
            own.append((s, "DIRECT_REFERENCE", t, score))
            edges.append((q, s, "DIRECT_REFERENCE", t, said[s], said[t], i))
        sources = {e[0] for e in own}
        tree = {p: [(f"{p}:K{k}", 0.55 * fit(said[f"{p}:K{k}"]) + 0.25 * (f"{p}:K{k}" in sources)) for k in (1, 2, 3)] for p in places}
        kids += [(q, p, f"{p}:K{k}", said[f"{p}:K{k}"], 10 * i + k) for i, p in enumerate(places) for k in (1, 2, 3)]
        want[q] = brute(own, tree)
    none = spark.createDataFrame([], "question_id int, locator string, text string, place int")
    paths, starts = answers.answer_paths(
        spark.createDataFrame(asked, "question_id int, question string, traversal boolean"), none,
        spark.createDataFrame(edges, "question_id int, source_locator string, relation_type string, target_locator string, source_text string, target_text string, place int"),
        spark.createDataFrame(kids, "question_id int, parent_locator string, locator string, text string, place int"),
    )
    got = {}
    for p in paths.orderBy("question_id", "place").collect():
        got.setdefault(p.question_id, []).append([tuple(s) for s in p.steps])
    assert got == {q: p for q, p in want.items() if p}
    chosen = {s.question_id: (s.source_locator, s.target_locator) for s in starts.where("selected").collect()}
    assert chosen == {q: (p[0][0][0], p[0][0][2]) for q, p in got.items()}


def case(spark, question, edges, kids, anchors=(), preferred=(), traversal=True, adjudicated=None):
    paths, starts = answers.answer_paths(
        spark.createDataFrame([(7, question, traversal)], "question_id int, question string, traversal boolean"),
        spark.createDataFrame([(7, *a, i) for i, a in enumerate(anchors)], "question_id int, locator string, text string, place int"),
        spark.createDataFrame([(7, *e, i) for i, e in enumerate(edges)], "question_id int, source_locator string, relation_type string, target_locator string, source_text string, target_text string, place int"),
        spark.createDataFrame([(7, *k, i) for i, k in enumerate(kids)], "question_id int, parent_locator string, locator string, text string, place int"),
        spark.createDataFrame([(7, p) for p in preferred], "question_id int, locator string"),
        adjudicated=None if adjudicated is None else spark.createDataFrame([(7, *a) for a in adjudicated], "question_id int, source_locator string, relation_type string, target_locator string, probability double"),
    )
    return [[tuple(s) for s in p.steps] for p in paths.orderBy("place").collect()], starts


def test_conditions_start_from_the_list_and_keep_its_leaves(spark):
    edges = [("LD2024:A10:K3", "DIRECT_REFERENCE", "LD2024:A10:K2", "tiếp tục sử dụng", "điều kiện"), ("LD2024:A10:K2:Da", "REQUIRES_CONDITION_FROM", "LD2024:A10:K1", "điều kiện tại khoản 1", "bán tài sản phải có điều kiện")]
    kids = [("LD2024:A10:K1", "LD2024:A10:K1:Da", "đã đăng ký theo luật"), ("LD2024:A10:K1", "LD2024:A10:K1:Db", "có giấy tờ, phải xây xong")]
    got, _ = case(spark, "Điều kiện bán tài sản?", edges, kids, [("LD2024:A10:K2", "bán tài sản")])
    assert all(p[0] == ("LD2024:A10:K2:Da", "REQUIRES_CONDITION_FROM", "LD2024:A10:K1") for p in got)
    assert {p[-1][2] for p in got} == {"LD2024:A10:K1:Da", "LD2024:A10:K1:Db"}


def test_children_that_neither_fit_nor_refer_are_left_out(spark):
    edges = [("LD2024:A3:K1", "INHERITS_RIGHTS_OBLIGATIONS", "LD2024:A2", "quyền theo Điều 2", "Quyền của tổ chức")]
    got, _ = case(spark, "Ai được áp dụng?", edges, [("LD2024:A2", "LD2024:A2:K1", "quy định chung")])
    assert got == [[("LD2024:A3:K1", "INHERITS_RIGHTS_OBLIGATIONS", "LD2024:A2")]]


def test_a_sale_with_the_lease_takes_the_other_list(spark):
    edges = [("LD2024:A1:K1", "DIRECT_REFERENCE", "LD2024:A2", "bán tài sản", "điều kiện bán tài sản")]
    kids = [("LD2024:A2", "LD2024:A2:K1", "bán tài sản khi có đủ các điều kiện"), ("LD2024:A2", "LD2024:A2:K2", "bán tài sản và quyền thuê trong hợp đồng khi có đủ các điều kiện")]
    ends = [case(spark, q, edges, kids)[0][0][-1][2] for q in ("điều kiện bán tài sản", "điều kiện bán tài sản cùng quyền thuê trong hợp đồng")]
    assert ends == ["LD2024:A2:K1", "LD2024:A2:K2"]


def test_a_service_has_a_twentieth(spark):
    edges = [("LD2024:A1", "DIRECT_REFERENCE", "LD2024:A3", "thế chấp", "thế chấp"), ("LD2024:A2", "DIRECT_REFERENCE", "LD2024:A4", "thế chấp", "thế chấp")]
    assert case(spark, "thế chấp", edges, [])[0] == [[edges[0][:3]]]
    assert case(spark, "thế chấp", edges, [], adjudicated=[(*edges[1][:3], 0.9), (*edges[0][:3], 0.1)])[0] == [[edges[1][:3]]]
    assert case(spark, "thế chấp", edges, [], preferred=["LD2024:A4"])[0] == [[edges[1][:3]]]


def test_nothing_to_start_from(spark):
    got, starts = case(spark, "thế chấp", [("LD2024:A1", "DIRECT_REFERENCE", "external:LD2024:A99", "x", ""), ("", "DIRECT_REFERENCE", "LD2024:A1", None, None)], [])
    assert got == [] and starts.count() == 0


def test_a_text_is_read_once_for_all_questions(spark, sf):
    from lexigrove.plans.answer_queries import document_scores

    plan = document_scores(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1


def test_described_odd_texts(spark):
    from lexigrove.functions import text as T

    texts = [None, "", "  ", "Straße ẞ İstanbul ŉ", "Người sử dụng đất THẾ CHẤP", "nguời été xͅyz", "αβγ 日本語 abc1", "phai co dieu kien " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.fold(F.coalesce("t", F.lit(""))).alias("f"), T.token_set(F.coalesce("t", F.lit(""))).alias("k"), answers.described("t").alias("d"), answers.described("t", whole=False).alias("s"))
    for r in rows.collect():
        assert (r.d.folded, r.d.tokens) == (r.f, r.k)
        assert r.d.marks == [p for p in answers.PHRASES if p in r.f]
        assert {k: v for k, v in r.d.asDict().items() if k != "folded"} == r.s.asDict()
