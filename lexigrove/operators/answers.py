"""What questions ask for, how well texts fit, and paths of proof, for whole tables of questions.

A text is folded once. One pass over it gives its tokens and its marks: which of the fixed phrases stand in it. All roles,
concepts, regimes, facets and actions of questions and texts are set algebra on these two arrays, so a pair of question and
text is scored by column expressions, without another look at either text.

Paths of all questions grow side by side: a step is one join of the paths' ends with the moves there, references and
children, and ranks within each path say which moves are taken. Nothing is collected; the number of joins is the depth.
Every table is keyed by question_id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import dropped, staged
from .retrieve import ACTIONS, FACETS, folded, question_tokens

# Phrases of roles, the variants of a concept, regimes that part one branch from another, cues of what is asked.
ROLES = {
    "subject": ["tổ chức kinh tế", "cá nhân", "người sử dụng đất", "người gốc việt nam định cư ở nước ngoài", "vốn đầu tư nước ngoài", "doanh nghiệp có vốn đầu tư nước ngoài", "tổ chức tôn giáo", "đơn vị sự nghiệp công lập"],
    "legal_regime": [
        "trả tiền thuê đất hằng năm", "thu tiền thuê đất hằng năm", "quyền thuê trong hợp đồng thuê đất", "thuê lại đất", "khu công nghiệp", "cụm công nghiệp", "khu công nghệ cao",
        "giao đất có thu tiền sử dụng đất", "thuê đất một lần",
    ],
}
CONCEPTS = {
    "economic_organization": ["tổ chức kinh tế", "doanh nghiệp"],
    "foreign_invested_entity": ["doanh nghiệp có vốn đầu tư nước ngoài", "tổ chức kinh tế có vốn đầu tư nước ngoài", "vốn đầu tư nước ngoài"],
    "annual_land_rent": ["trả tiền thuê đất hằng năm", "thu tiền thuê đất hằng năm", "trả tiền hằng năm", "thuê lại đất hằng năm", "nộp tiền hằng năm"],
    "industrial_zone": ["khu công nghiệp", "cụm công nghiệp", "khu công nghệ cao"],
}
REGIMES = ["vốn đầu tư nước ngoài", "khu công nghiệp", "cụm công nghiệp", "khu công nghệ cao", "đơn vị sự nghiệp", "tổ chức tôn giáo", "kết cấu hạ tầng", "dự án đầu tư"]
CUES = ["muon", "co quyen", "duoc", "can"]
ORIGIN = ["quyen ban", "xac dinh quyen"]
LEASE_TOO = ["quyen thue trong hop dong", "ban dong thoi", "cung quyen thue"]
LISTS = ["bao gom", "liet ke", "nhung gi", "cac dieu kien"]
ALL_CONDITIONS, CONDITIONS_BELOW, LEASE = "khi co du cac dieu kien", "dieu kien sau day", "quyen thue trong hop dong"
CONDITION_WORDS = ["dieu kien", "phai", "da ", "co "]

_ROLES = {r: [folded(p) for p in ps] for r, ps in ROLES.items()}
_CONCEPTS = {c: [folded(p) for p in ps] for c, ps in CONCEPTS.items()}
_REGIMES = [folded(p) for p in REGIMES]
_FACETS = {f: [folded(p) for p in ps] for f, ps in FACETS.items()} | {"LIST": LISTS, "RIGHT_ORIGIN": ORIGIN}
PHRASES = list(dict.fromkeys([p for table in (_ROLES, _CONCEPTS, _FACETS) for ps in table.values() for p in ps] + _REGIMES + LEASE_TOO + [ALL_CONDITIONS, CONDITIONS_BELOW, LEASE, *CONDITION_WORDS]))

STEP = "array<struct<source:string,type:string,target:string>>"


def _texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _tokens(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)")))
    return F.array_except(F.filter(found, lambda t: F.length(t) > 2), _texts(T.QUESTION_STOPWORDS))


def _named(named: dict[str, Column]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]).cast("array<string>"))


_ACTION_TOKENS = {folded(a): question_tokens(a) for a in ACTIONS}


def _actions(tokens: Column) -> Column:
    """The actions all of whose tokens are there, whatever stands between them."""
    # a text's tokens are looked through once, and its few tokens of actions for each action
    some = F.array(F.array_intersect(tokens, _texts(list(dict.fromkeys(t for ts in _ACTION_TOKENS.values() for t in ts)))))
    return F.get(F.transform(some, lambda found: _named({a: F.size(F.array_except(_texts(ts), found)) == 0 for a, ts in _ACTION_TOKENS.items()})), F.lit(0))


def _any(marks: Column, phrases: list[str]) -> Column:
    return F.arrays_overlap(marks, _texts(phrases))


def _seen(text: Column, whole: bool) -> Column:
    """struct(folded, tokens, marks) of a text that is not null: folded, read for tokens and looked through for phrases where it lies."""
    stop, phrases = frozenset(T.QUESTION_STOPWORDS), list(PHRASES)

    def read(t: str) -> tuple[str | None, list[str], list[str]]:
        f = t.lower() if t.isascii() else folded(t)
        tokens = dict.fromkeys(x for x in re.findall("[a-z0-9]+", f) if len(x) > 2)
        return f if whole else None, [x for x in tokens if x not in stop], [p for p in phrases if p in f]

    return T.by_rows(read, "folded string, tokens array<string>, marks array<string>")(text)


def described(text: Column | str, whole: bool = True) -> Column:
    """struct(folded, tokens, marks, actions, concepts, regimes) of a text; null counts as empty. Without `whole` no folded."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def more(s: Column) -> Column:
        concepts = _named({c: _any(s["marks"], ps) for c, ps in _CONCEPTS.items()})
        parts = [s["folded"].alias("folded")] if whole else []
        return F.struct(*parts, s["tokens"].alias("tokens"), s["marks"].alias("marks"), _actions(s["tokens"]).alias("actions"), concepts.alias("concepts"), F.array_intersect(s["marks"], _texts(_REGIMES)).alias("regimes"))

    return F.get(F.transform(F.array(_seen(text, whole)), more), F.lit(0))  # what is read is bound once


def profile(question: Column | str) -> Column:
    """struct(tokens, actions, subject, legal_regime, concepts, facets, known, lease) of a question.

    Of several actions those after the first cue that governs any count ("wants to", "has the right to", "may", "needs"). known:
    regimes whose tokens the question has; lease: whether the right of lease goes along.
    """

    def read(d: Column) -> Column:
        tails = [_actions(_tokens(F.regexp_extract(d["folded"], rf"(?U)\b{cue}\b\s+([^.!?;:]{{0,100}})", 1))) for cue in CUES]
        focused = F.coalesce(*[F.when(F.size(t) > 0, t) for t in tails], d["actions"])
        facets = F.sort_array(_named({f: _any(d["marks"], ps) for f, ps in _FACETS.items()}))
        known = _named({r: F.size(F.array_except(_texts(question_tokens(r)), d["tokens"])) == 0 for r in _REGIMES})
        roles = [F.array_intersect(d["marks"], _texts(ps)).alias(r) for r, ps in _ROLES.items()]
        return F.struct(d["tokens"].alias("tokens"), focused.alias("actions"), *roles, d["concepts"].alias("concepts"), facets.alias("facets"), known.alias("known"), _any(d["marks"], LEASE_TOO).alias("lease"))

    return F.get(F.transform(F.array(described(question)), read), F.lit(0))


def acts(q: Column, d: Column) -> Column:
    """Whether a text names an action that is asked for."""
    return F.arrays_overlap(q["actions"], d["actions"])


def fit(q: Column, d: Column) -> Column:
    """How well a text (`described`) fits a question (`profile`): tokens, action, roles and concepts, less what is out of scope.

    Each distinctive regime that the question does not name costs 0.10, up to 0.30; each concept asked for and missing 0.18,
    up to 0.42.
    """
    token = F.size(F.array_intersect(q["tokens"], d["tokens"])) / F.greatest(F.lit(1), F.size(q["tokens"]))
    found = F.size(F.array_intersect(q["concepts"], d["concepts"]))
    roles = [q[r] for r in _ROLES]
    asked = sum([(F.size(r) > 0).cast("int") for r in roles], F.size(q["concepts"]))
    hits = sum([F.arrays_overlap(r, d["marks"]).cast("int") for r in roles], found)
    role = F.when(asked > 0, hits / asked).otherwise(0.0)
    mismatch = F.least(F.lit(0.30), 0.10 * F.size(F.array_except(d["regimes"], q["known"])))
    missing = F.least(F.lit(0.42), 0.18 * (F.size(q["concepts"]) - found))
    return F.greatest(F.lit(0.0), 0.45 * token + 0.35 * acts(q, d).cast("double") + 0.20 * role - mismatch - missing)


def profiles(questions: DataFrame, question: str = "question") -> DataFrame:
    """(question_id, q) of a table of questions."""
    return questions.select("question_id", profile(question).alias("q"))


def _node_texts(anchors: DataFrame, context: DataFrame | None, children: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, locator, text): a place's text as the records give it, the last one; else a child's, else an edge's, the first."""
    told = lambda df, locator, text, tier, place: df.select("question_id", F.col(locator).alias("locator"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.lit(tier).alias("tier"), place.cast("long").alias("at")).alias("rank"))
    rows = told(anchors, "locator", "text", 1, -F.col("place"))
    if context is not None:
        rows = rows.unionByName(told(context, "locator", "text", 0, -F.col("place")))
    rows = rows.unionByName(told(children, "locator", "text", 2, F.col("place")))
    for end, more in (("source", 0), ("target", 1)):
        rows = rows.unionByName(told(edges, f"{end}_locator", f"{end}_text", 3, 2 * F.col("place") + more))
    return rows.where("locator is not null").groupBy("question_id", "locator").agg(F.min_by("text", "rank").alias("text"))


def scored_edges(asked: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges with the score of a start from them. asked: (question_id, q, anchors, preferred, traversal); texts: `_node_texts`.

    A point says little by itself, so the text of the place above it counts with its own. Where a right comes from is asked
    of the source more than of the target, and not of a list of conditions; a question about conditions is the other way round.
    """
    source, facets = F.col("source_locator"), F.col("q.facets")
    own = edges.where("source_locator <> '' and target_locator <> '' and not startswith(target_locator, 'external:')").join(asked, "question_id")
    own = own.withColumn("up", F.when(F.contains(source, F.lit(":D")), F.regexp_replace(source, ":[^:]*$", "")))
    own = own.join(texts.select("question_id", F.col("locator").alias("up"), F.col("text").alias("up_text")), ["question_id", "up"], "left")
    said = F.concat_ws(" ", F.coalesce("source_text", F.lit("")), F.coalesce("up_text", F.lit("")))
    own = own.withColumns({"s": described(said), "t": described("target_text")})
    own = own.withColumns({"source_fit": fit(F.col("q"), F.col("s")), "target_fit": fit(F.col("q"), F.col("t")), "lists_conditions": F.array_contains("s.marks", ALL_CONDITIONS)})
    origin, condition = F.array_contains(facets, "RIGHT_ORIGIN"), F.array_contains(facets, "CONDITION")
    mixed = F.when(origin, 0.75 * F.col("source_fit") + 0.25 * F.col("target_fit")).otherwise(0.40 * F.col("source_fit") + 0.60 * F.col("target_fit"))
    meaning = F.when(origin & F.col("lists_conditions"), F.greatest(F.lit(0.0), mixed - 0.30)).when(condition & F.col("lists_conditions"), mixed + 0.32).otherwise(mixed)
    near = F.exists("anchors", lambda a: T.related(source, a))
    liked = F.array_contains("preferred", source) | F.array_contains("preferred", F.col("target_locator"))
    relation = F.col("relation_type")
    suits = (
        F.when(condition & (relation == "REQUIRES_CONDITION_FROM"), 1.0)
        .when(F.array_contains(facets, "EXCEPTION") & (relation == "EXCEPTION_REFERENCE"), 1.0)
        .when(F.col("traversal") & (relation == "INHERITS_RIGHTS_OBLIGATIONS"), 0.75)
        .when(relation == "DIRECT_REFERENCE", 0.25)
        .otherwise(0.0)
    )
    score = 0.50 * meaning + 0.22 * near.cast("double") + 0.15 * suits + 0.08 * liked.cast("double") + 0.05 * (T.locator_depth(source) / 2)
    return own.select("question_id", "source_locator", "relation_type", "target_locator", F.col("place").cast("long").alias("place"), "source_fit", "target_fit", "lists_conditions", F.round(score, 6).alias("score"))


def _child_moves(asked: DataFrame, children: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Children as moves from their parents, with all that the choice between them needs."""
    kids = children.where("parent_locator is not null and locator is not null").groupBy("question_id", "parent_locator", "locator").agg(F.min("place").cast("long").alias("place"))
    of = lambda name: texts.select("question_id", F.col("locator").alias(name), F.col("text").alias(f"{name}_text"))
    kids = kids.join(of("locator"), ["question_id", "locator"], "left").join(of("parent_locator"), ["question_id", "parent_locator"], "left").join(asked, "question_id")
    starts = edges.select("question_id", F.col("source_locator").alias("locator")).distinct().withColumn("connector", F.lit(True))
    kids = kids.join(starts, ["question_id", "locator"], "left").withColumn("connector", F.coalesce("connector", F.lit(False)))
    kids = kids.withColumns({"d": described("locator_text"), "above": described("parent_locator_text")})
    condition = F.array_contains("q.facets", "CONDITION")
    liked = F.array_contains("preferred", F.col("locator")) | F.array_contains("preferred", F.col("parent_locator"))
    value = 0.55 * fit(F.col("q"), F.col("d")) + 0.25 * F.col("connector").cast("double") + 0.10 * liked.cast("double") + 0.10 * (condition & _any(F.col("d.marks"), CONDITION_WORDS)).cast("double")
    lease = F.col("q.lease")
    return kids.select(
        "question_id", F.col("parent_locator").alias("node"), F.col("locator").alias("to"), F.lit("PARENT_CHILD_CONTEXT").alias("type"), "place", value.alias("value"), F.lit(False).alias("edge"), "connector",
        acts(F.col("q"), F.col("d")).alias("acts"), (condition & _any(F.col("d.marks"), [ALL_CONDITIONS, CONDITIONS_BELOW])).alias("container"),
        F.when(F.array_contains("d.marks", LEASE) == lease, 0.45).otherwise(-0.45).alias("lease_fit"), condition.alias("condition"),
        (_any(F.col("above.marks"), [ALL_CONDITIONS, CONDITIONS_BELOW]) & ~F.array_contains("above.marks", LEASE)).alias("whole_list"), (lease & F.array_contains("above.marks", LEASE)).alias("lease_only"),
    )


def _onward(front: DataFrame, moves: DataFrame, fan_out: int) -> DataFrame:
    """The paths that go on, by the moves taken: references first, else children."""
    path = ["question_id", "trail"]
    whole, kind = Window.partitionBy(*path), Window.partitionBy(*path, "edge")
    order = [F.desc("value"), F.col("place")]
    met = front.join(moves, ["question_id", "node"]).where(~F.array_contains("seen", F.col("to")))
    met = met.withColumn("any_edge", F.max("edge").over(whole)).where(F.col("edge") == F.col("any_edge"))
    met = met.withColumns({
        "n": F.row_number().over(kind.orderBy(*order)),
        "n_acts": F.row_number().over(kind.orderBy(F.desc("acts"), *order)),
        "n_box": F.row_number().over(kind.orderBy(F.desc("container"), F.desc(F.col("value") + F.col("lease_fit")), *order)),
        "any_box": F.max("container").over(kind), "any_acts": F.max("acts").over(kind),
    })
    taken = (
        F.when(F.col("edge"), F.col("n") <= fan_out)
        .when(F.col("any_box"), F.col("n_box") == 1)
        .when(F.col("any_acts"), F.col("acts") & (F.col("n_acts") <= 2))
        .when(F.col("condition"), F.col("whole_list") | ((F.col("value") >= 0.10) & (F.col("n") <= 5)))
        .otherwise((F.col("value") >= 0.22) & (F.col("n") <= 2))
    )
    met = met.withColumn("taken", taken).withColumn("any_link", F.max(F.col("taken") & F.col("connector")).over(kind))
    met = met.where(F.col("taken") & (F.col("edge") | ~(F.col("lease_only") & F.col("any_link")) | F.col("connector")))
    step = F.struct(F.col("node").alias("source"), "type", F.col("to").alias("target"))
    return met.select(
        "question_id", F.concat("trail", F.array("n")).alias("trail"), F.col("to").alias("node"), F.concat("seen", F.array("to")).alias("seen"),
        F.concat("steps", F.array(step)).cast(STEP).alias("steps"), (F.col("total") + F.col("value")).alias("total"), "root_score",
    )


def answer_paths(
    questions: DataFrame, anchors: DataFrame, edges: DataFrame, children: DataFrame, preferred: DataFrame | None = None, context: DataFrame | None = None, adjudicated: DataFrame | None = None,
    roots: int = 12, paths: int = 6, depth: int = 6, fan_out: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Paths of proof of each question and the edges that they may start from.

    questions: (question_id, question, traversal), traversal saying whether references are to be followed; anchors, context:
    (question_id, locator, text, place); edges: (question_id, source_locator, relation_type, target_locator, source_text,
    target_text, place); children: (question_id, parent_locator, locator, text, place); preferred: (question_id, locator);
    adjudicated: (question_id, source_locator, relation_type, target_locator, probability), a service's word on starts, which
    counts for a twentieth. place is the order of a question's rows and unique there.

    Result: (question_id, place, score, steps) with at most `paths` a question, all of its best start, and (question_id, place,
    source_locator, relation_type, target_locator, score, source_fit, target_fit, lists_conditions, completed, selected).
    A path goes on by its two best references, else by the children that hold the conditions, do the action or fit; no place
    is met twice; none is a beginning of another. Questions without an edge have no row.
    """
    listed = lambda df, name: df.groupBy("question_id").agg(F.collect_set("locator").alias(name))  # noqa: E731  of one question
    nothing = F.array().cast("array<string>")
    asked = questions.select("question_id", profile("question").alias("q"), F.coalesce("traversal", F.lit(False)).alias("traversal")).join(listed(anchors, "anchors"), "question_id", "left")
    asked = asked.join(listed(preferred, "preferred"), "question_id", "left") if preferred is not None else asked.withColumn("preferred", nothing)
    asked = staged(asked.withColumns({c: F.coalesce(c, nothing) for c in ("anchors", "preferred")}), "asked")
    texts = staged(_node_texts(anchors, context, children, edges), "asked-texts")
    scored = staged(scored_edges(asked, edges, texts), "asked-edges")

    none, key = F.lit(False), ["source_locator", "relation_type", "target_locator"]
    moves = scored.select(
        "question_id", F.col("source_locator").alias("node"), F.col("target_locator").alias("to"), F.col("relation_type").alias("type"), "place", F.col("score").alias("value"), F.lit(True).alias("edge"), none.alias("connector"),
        none.alias("acts"), none.alias("container"), F.lit(0.0).alias("lease_fit"), none.alias("condition"), none.alias("whole_list"), none.alias("lease_only"),
    )
    moves = staged(moves.unionByName(_child_moves(asked, children, scored, texts)), "asked-moves")

    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "place")
    starts = scored.where("score > 0").withColumn("n", F.row_number().over(best)).where(F.col("n") <= roots).drop("place")
    starts = starts.withColumn("root_score", F.min("score").over(Window.partitionBy("question_id", *key)))
    if adjudicated is not None:
        starts = starts.join(adjudicated, ["question_id", *key], "left").withColumn("root_score", F.coalesce(0.95 * F.col("root_score") + 0.05 * F.col("probability"), "root_score"))
        starts = starts.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.coalesce("probability", F.lit(0.0))), F.desc("score"), "n"))).drop("probability")
    starts = staged(starts, "asked-starts")
    step = F.struct(F.col("source_locator").alias("source"), F.col("relation_type").alias("type"), F.col("target_locator").alias("target"))
    front = starts.select("question_id", F.array("n").alias("trail"), F.col("target_locator").alias("node"), F.array("source_locator", "target_locator").alias("seen"), F.array(step).cast(STEP).alias("steps"), F.col("score").alias("total"), "root_score")
    done, held = None, []
    for _ in range(depth - 1):
        further = staged(_onward(front, moves, fan_out), "asked-paths")
        gone = further.select("question_id", F.slice("trail", 1, F.size("trail") - 1).alias("trail")).distinct()
        ended = front.join(gone, ["question_id", "trail"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        held.append(further)
        front = further
    done = staged((front if done is None else done.unionByName(front)).drop("seen", "node"), "asked-done")

    one = done.groupBy("question_id", "steps").agg(F.max("total").alias("total"), F.min("trail").alias("trail"), F.max("root_score").alias("root_score"))
    heads = one.where(F.size("steps") > 1).select("question_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps") - 1), lambda n: F.slice("steps", F.lit(1), n))).alias("steps")).distinct()
    one = one.join(heads, ["question_id", "steps"], "left_anti")
    score = 0.70 * F.col("root_score") + 0.30 * (F.col("total") - F.col("root_score")) / F.greatest(F.lit(1), F.size("steps") - 1)
    ranked = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc(F.size("steps")), "trail")
    one = one.withColumn("score", F.round(score, 9)).withColumn("first", F.first(F.get("steps", F.lit(0))).over(ranked)).where(F.get("steps", F.lit(0)) == F.col("first"))
    out = staged(one.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= paths).select("question_id", "place", "score", "steps"), "answer-paths")

    counts = done.groupBy("question_id", F.get("trail", F.lit(0)).alias("n")).agg(F.count("*").alias("completed"))
    chosen = out.where("place = 1").select("question_id", *[F.get("steps", F.lit(0))[f].alias(c) for f, c in (("source", key[0]), ("type", key[1]), ("target", key[2]))], F.lit(True).alias("selected"))
    told = starts.join(counts, ["question_id", "n"]).join(chosen, ["question_id", *key], "left")
    told = staged(told.select("question_id", F.col("n").alias("place"), *key, "score", "source_fit", "target_fit", "lists_conditions", "completed", F.coalesce("selected", F.lit(False)).alias("selected")), "answer-starts")
    dropped(asked, texts, scored, moves, starts, done, *held)
    return out, told
