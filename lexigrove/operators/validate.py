"""Integrity rules on trees, quarantine, reports. Every rule gives rows (rule_id, node_id, severity, issue_type, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import dropped, staged

# Sequences of markers, node types that may be roots, and types whose text may not be empty.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX", "XXI", "XXII", "XXIII", "XXIV", "XXV", "XXVI", "XXVII", "XXVIII", "XXIX", "XXX", "XXXI", "XXXII", "XXXIII", "XXXIV", "XXXV", "XXXVI", "XXXVII", "XXXVIII", "XXXIX", "XL", "XLI", "XLII", "XLIII", "XLIV", "XLV", "XLVI", "XLVII", "XLVIII", "XLIX", "L"]
LETTERS = ["a", "b", "c", "d", "đ", "e", "g", "h", "i", "k", "l", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "x", "y"]
#: Missing numbers that are named one by one in a hole, unless a caller says otherwise.
MOST_MISSING = 10_000
ROOT_TYPES, TEXT_TYPES = ["PART", "CHAPTER", "TEXT"], ["CLAUSE", "POINT", "TEXT"]


def _issues(rows: DataFrame, rule: str, severity: str, kind: str, message: Column, node: str | Column = "id") -> DataFrame:
    node = F.col(node) if isinstance(node, str) else node
    return rows.select(F.lit(rule).alias("rule_id"), node.cast("string").alias("node_id"), F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), message.alias("message"))


def bad_schema(nodes: DataFrame) -> DataFrame:
    """VAL-000: rows that lack an id or type, or whose numbers do not parse."""
    numbers = [c for c in ("depth", "position", "start_idx", "end_idx") if c in nodes.columns]
    broken = F.col("id").isNull() | F.col("type").isNull()
    for c in numbers:
        broken = broken | (F.col(c).isNotNull() & F.expr(f"try_cast(cast({c} as string) as int)").isNull())
    return _issues(nodes.where(broken), "VAL-000", "ERROR", "SchemaError", F.lit("a required field is missing or has the wrong type"))


def duplicate_ids(nodes: DataFrame, order: str = "start_idx") -> DataFrame:
    """VAL-001: every occurrence of an id after the first."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return _issues(nodes.withColumn("__n", n).where("__n > 1"), "VAL-001", "ERROR", "DuplicateId", F.concat(F.lit("id occurs again: "), F.col("id").cast("string")))


def orphans(nodes: DataFrame) -> DataFrame:
    """VAL-002: no parent, and of a type that needs one."""
    return _issues(nodes.where(F.col("parent_id").isNull() & ~F.col("type").isin(ROOT_TYPES)), "VAL-002", "ERROR", "OrphanNode", F.concat(F.col("type"), F.lit(" has no parent")))


def broken_parents(nodes: DataFrame) -> DataFrame:
    """VAL-003: the parent is no node."""
    ids = nodes.select(F.col("id").alias("parent_id")).distinct()
    lost = nodes.where("parent_id is not null").join(ids, "parent_id", "left_anti")
    return _issues(lost, "VAL-003", "ERROR", "BrokenParent", F.concat(F.lit("parent is missing: "), F.col("parent_id").cast("string")))


def on_cycles(nodes: DataFrame, child: str = "id", parent: str = "parent_id") -> DataFrame:
    """Ids of nodes that are their own ancestors.

    Pointers are doubled: after k rounds a node points 2^k steps up, and all whose way ends at a root have left. When the
    steps outnumber the nodes left, the targets are just the nodes on cycles. A row a node, a join a round; no round's table
    goes through the driver.
    """
    step = staged(nodes.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("n"), F.col(parent).alias("to")).distinct(), "cycle-steps")
    taken = 1
    while True:
        left = step.count()
        if left == 0 or taken > left:
            return step.select(F.col("to").alias(child)).distinct()
        ahead = step.select(F.col("n").alias("to"), F.col("to").alias("next"))
        old, step = step, staged(step.join(ahead.hint("merge"), "to").select("n", F.col("next").alias("to")).distinct(), "cycle-steps")
        dropped(old)
        taken *= 2


def cycles(nodes: DataFrame) -> DataFrame:
    """VAL-004."""
    return _issues(on_cycles(nodes), "VAL-004", "ERROR", "CyclicDependency", F.lit("the node is its own ancestor"))


def empty_nodes(nodes: DataFrame) -> DataFrame:
    """VAL-005."""
    return _issues(nodes.where(F.col("type").isin(TEXT_TYPES) & (F.trim(F.coalesce("text", F.lit(""))) == "")), "VAL-005", "WARNING", "EmptyNode", F.lit("the node has no text"))


def integrity(nodes: DataFrame) -> DataFrame:
    return duplicate_ids(nodes).unionByName(orphans(nodes)).unionByName(broken_parents(nodes)).unionByName(cycles(nodes)).unionByName(empty_nodes(nodes))


def marker_of(nodes: DataFrame) -> Column:
    """The number or point letter of a node, from its column or else from its title."""
    title = F.trim("title")
    of_title = (
        F.when(F.col("type") == "CHAPTER", F.regexp_extract(title, r"Chương\s+([IVXLCDM]+)", 1))
        .when(F.col("type") == "SECTION", F.regexp_extract(title, r"Mục\s+(\d+)", 1))
        .when(F.col("type") == "ARTICLE", F.regexp_extract(title, r"Điều\s+(\d+)", 1))
        .when(F.col("type") == "CLAUSE", F.regexp_extract(title, r"^(\d+)\.", 1))
        .when(F.col("type") == "POINT", F.lower(F.regexp_extract(title, r"^(?iu)([a-zđ])\)", 1)))
    )
    own = F.when(F.col("type") == "POINT", F.lower("marker")).otherwise(F.col("number").cast("string"))
    return F.coalesce(own, F.nullif(of_title, F.lit("")))


def gap_intervals(nodes: DataFrame) -> DataFrame:
    """(parent_id, type, low, high): the holes in the markers of siblings of a type, one row each, however long.

    Markers are those between the first and the last in the order of the text: numbers, and places in the alphabet of Roman
    numerals or letters. A descending pair of ends spans nothing; a letter outside the alphabet or a number that is none
    counts for nothing.
    """
    roman = F.array_position(F.array(*map(F.lit, ROMAN)), F.col("mark"))
    letter = F.array_position(F.array(*map(F.lit, LETTERS)), F.col("mark"))
    number = F.expr("try_cast(mark as bigint)")
    marked = nodes.withColumn("mark", marker_of(nodes)).where("mark is not null")
    value = F.when(F.col("type") == "CHAPTER", F.nullif(roman, F.lit(0))).when(F.col("type") == "POINT", F.nullif(letter, F.lit(0))).otherwise(number)
    ends = Window.partitionBy("parent_id", "type").orderBy("start_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # letters and Roman numerals need both ends in their alphabet
    spans = marked.withColumn("v", value.cast("long")).withColumns({"low": F.first("v", ignorenulls=True).over(ends), "high": F.last("v", ignorenulls=True).over(ends)})
    for c, f in (("first", F.first), ("last", F.last)):
        spans = spans.withColumn(f"{c}_v", f("v").over(ends))
    spans = staged(spans.select("parent_id", "type", "v", "low", "high", "first_v", "last_v"), "gap-spans")  # read twice
    strict = F.col("type").isin("CHAPTER", "POINT")
    groups = spans.groupBy("parent_id", "type").agg(
        F.first("low").alias("low"), F.first("high").alias("high"), F.count("*").alias("n"), F.count("v").alias("n_values"), F.first(F.col("first_v").isNotNull() & F.col("last_v").isNotNull()).alias("whole")
    )
    open_ = groups.where((F.col("n") >= 2) & (F.col("low") <= F.col("high")) & F.when(strict, F.col("whole")).otherwise(F.col("n_values") >= 2)).select("parent_id", "type", "low", "high")
    # what is missing lies between neighbouring values, so no array spans the whole
    same = F.col("v.parent_id").eqNullSafe(F.col("o.parent_id")) & (F.col("v.type") == F.col("o.type"))
    values = spans.where("v is not null").select("parent_id", "type", "v").distinct()
    inside = values.alias("v").join(open_.alias("o"), same).where("v.v between o.low and o.high").select("v.parent_id", "v.type", "v.v")
    after = F.lead("v").over(Window.partitionBy("parent_id", "type").orderBy("v"))
    return inside.withColumn("next", after).where("next > v + 1").select("parent_id", "type", (F.col("v") + 1).alias("low"), (F.col("next") - 1).alias("high"))


def interval_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high): the whole numbers in an interval of `left` and in none of `right`, as intervals that do not touch.

    Both have `keys`, low and high, ends included; intervals may overlap and repeat. One sweep over the ends of each key: a
    stretch between neighbouring ends is in if some interval of the left and none of the right is open there.
    """
    ends = None
    for df, l, r in ((left, 1, 0), (right, 0, 1)):
        for at, sign in ((F.col("low"), 1), (F.col("high") + 1, -1)):
            part = df.where("low <= high").select(*keys, at.cast("long").alias("at"), F.lit(sign * l).alias("l"), F.lit(sign * r).alias("r"))
            ends = part if ends is None else ends.unionByName(part)
    ends = ends.groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    order = Window.partitionBy(*keys).orderBy("at")
    open_ = ends.select(*keys, "at", ((F.sum("l").over(order) > 0) & (F.sum("r").over(order) == 0)).alias("inside"))
    turns = open_.withColumn("before", F.lag("inside", 1, False).over(order)).where("inside <> before")
    return turns.withColumn("end", F.lead("at").over(order)).where("inside").select(*keys, F.col("at").alias("low"), (F.col("end") - 1).alias("high"))


def sequence_gaps(nodes: DataFrame, most_named: int = MOST_MISSING) -> DataFrame:
    """VAL-006: the missing markers of `gap_intervals`.

    `most_named`: a hole of so many numbers or more, as a wrong number makes it, is one row that names its ends.
    """
    holes = gap_intervals(nodes)
    short = F.col("high") - F.col("low") < most_named
    # a longer hole, as a wrong number makes it, is one row that names its ends
    missing = holes.withColumn("v", F.explode(F.when(short, F.sequence("low", F.least("high", F.col("low") + most_named))).otherwise(F.array("low"))))
    name = F.when(F.col("type") == "CHAPTER", F.get(F.array(*map(F.lit, ROMAN)), (F.col("v") - 1).cast("int"))).when(F.col("type") == "POINT", F.get(F.array(*map(F.lit, LETTERS)), (F.col("v") - 1).cast("int"))).when(short, F.col("v").cast("string")).otherwise(F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string")))
    node = F.concat_ws("_", F.lower("type"), name)
    return _issues(missing, "VAL-006", "WARNING", "GapIndex", F.concat(node, F.lit(" is missing under "), F.coalesce(F.col("parent_id").cast("string"), F.lit("root"))), node)


def descendants(nodes: DataFrame, roots: DataFrame, levels: int | None = None) -> DataFrame:
    """Ids of `roots` (column id) and of all below them: a join for each level, each on the newest level only."""
    edges = nodes.where("parent_id is not null").select(F.col("parent_id").alias("up"), "id")
    found = newest = staged(roots.select("id").distinct(), "descendants")
    n = 0
    while levels is None or n < levels:
        below = newest.select(F.col("id").alias("up")).join(edges, "up").select("id").distinct()
        newest = staged(below.join(found, "id", "left_anti"), "descendants")
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
        n += 1
    return found


def quarantine(nodes: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that stay, issues with one more for each node that goes only because an ancestor does).

    All copies of a duplicated id go. Errors that name no node take nothing along.
    """
    bad = issues.where("severity = 'ERROR'").select(F.col("node_id").alias("id")).distinct()
    gone = staged(descendants(nodes, bad), "quarantined")
    cascaded = gone.join(bad, "id", "left_anti").join(nodes.select("id").distinct(), "id", "left_semi")
    more = _issues(cascaded, "VAL-003", "ERROR", "BrokenParent", F.lit("an ancestor is quarantined"))
    return nodes.join(gone, "id", "left_anti"), issues.unionByName(more)


def report(received: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: nodes received and validated, errors, warnings, and the share of nodes without error in percent."""
    total = received.agg(F.count("*").alias("total_nodes_received"))
    found = issues.agg(F.count_if(F.col("severity") == "ERROR").alias("fatal_errors_count"), F.count_if(F.col("severity") == "WARNING").alias("warnings_count"))
    both = total.join(F.broadcast(found))  # one row each
    score = F.when(F.col("total_nodes_received") > 0, F.round((1 - F.col("fatal_errors_count") / F.col("total_nodes_received")) * 100, 2)).otherwise(F.lit(100.0))
    return both.select("total_nodes_received", (F.col("total_nodes_received") - F.col("fatal_errors_count")).alias("total_nodes_validated"), "fatal_errors_count", "warnings_count", score.alias("structural_integrity_score"))


def validate(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes that stay, issues, report)."""
    issues = staged(bad_schema(nodes).unionByName(integrity(nodes)).unionByName(sequence_gaps(nodes)), "issues")
    kept, told = quarantine(nodes, issues)
    return kept, told, report(nodes, told)


# Graph contracts.
# Types that may stand below one another.
HIERARCHY_PAIRS = [("SECTION", "CHAPTER"), ("ARTICLE", "CHAPTER"), ("ARTICLE", "SECTION"), ("CLAUSE", "ARTICLE"), ("POINT", "ARTICLE"), ("POINT", "CLAUSE"), ("POINT", "POINT")]
# Classes that an edge type may join.
CLASSES = ["LEGAL_SUBJECT", "LEGAL_ACTION", "LEGAL_OBJECT", "LEGAL_CONSEQUENCE", "CONDITION", "EXCEPTION", "LEGAL_DOCUMENT_REF", "PENALTY", "GLOBAL_NORM"]
SEMANTIC_PAIRS = {
    "ALLOW": [("LEGAL_SUBJECT", "LEGAL_ACTION")],
    "PROHIBIT": [("LEGAL_SUBJECT", "LEGAL_ACTION")],
    "REQUIRE": [("LEGAL_SUBJECT", "LEGAL_ACTION"), ("LEGAL_ACTION", "LEGAL_ACTION")],
    "HAS_CONDITION": [("LEGAL_SUBJECT", "CONDITION"), ("LEGAL_ACTION", "CONDITION"), ("GLOBAL_NORM", "CONDITION")],
    "HAS_EXCEPTION": [("LEGAL_ACTION", "EXCEPTION"), ("CONDITION", "EXCEPTION"), ("GLOBAL_NORM", "EXCEPTION")],
    "HAS_CONSEQUENCE": [("LEGAL_ACTION", "LEGAL_CONSEQUENCE"), ("GLOBAL_NORM", "LEGAL_CONSEQUENCE")],
    "REFERENCE_TO": [(c, "LEGAL_DOCUMENT_REF") for c in ("LEGAL_SUBJECT", "LEGAL_ACTION", "CONDITION", "EXCEPTION", "PENALTY", "LEGAL_DOCUMENT_REF", "LEGAL_OBJECT")],
    "HAS_PENALTY": [("LEGAL_ACTION", "PENALTY")],
    "HAS_OBJECT": [("LEGAL_ACTION", "LEGAL_OBJECT"), ("LEGAL_ACTION", "LEGAL_SUBJECT"), ("LEGAL_SUBJECT", "LEGAL_OBJECT"), ("LEGAL_SUBJECT", "LEGAL_SUBJECT"), ("GLOBAL_NORM", "LEGAL_OBJECT")],
    "HAS_SUBJECT": [("GLOBAL_NORM", "LEGAL_SUBJECT")],
    "HAS_ACTION": [("GLOBAL_NORM", "LEGAL_ACTION")],
    "DENOTES": [(c, c) for c in CLASSES],
    "IS_A": [(c, c) for c in CLASSES],
}


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a missing end: (source, target, missing_nodes)."""
    ids = nodes.select("id").distinct()
    found = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("has_source")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    missing = F.array_compact(F.array(F.when(F.col("has_source").isNull(), F.col("source")), F.when(F.col("has_target").isNull(), F.col("target"))))
    return found.withColumn("missing_nodes", missing).where(F.size("missing_nodes") > 0).select("source", "target", "missing_nodes")


def lone_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def has_cycle(edges: DataFrame) -> bool:
    """Whether a set of edges has a directed cycle.

    Nodes without incoming or without outgoing edges are peeled off, and where a node has one way in and one way out, its
    two edges become one; so a chain halves in each round, and rounds grow with the logarithm of its length.
    """
    left = staged(edges.select("source", "target").distinct(), "peel")
    while True:
        if not left.where("source = target").isEmpty():
            return True
        sources, targets = left.select(F.col("source").alias("target")).distinct(), left.select(F.col("target").alias("source")).distinct()
        inner = staged(left.join(targets, "source", "left_semi").join(sources, "target", "left_semi").select("source", "target"), "peel")
        rest = inner.count()
        if rest == 0:
            return False
        if rest == left.count():
            return True  # every way goes on, and so comes back
        # nodes on a chain, of which every other one, by a hash that beats its neighbours', is left out
        once = lambda c: inner.groupBy(F.col(c).alias("n")).agg(F.count("*").alias("k"), F.min("target" if c == "source" else "source").alias("x")).where("k = 1").drop("k")
        chain = once("source").withColumnRenamed("x", "to").join(once("target").withColumnRenamed("x", "from"), "n")
        h = lambda c: F.xxhash64(F.lit(7), F.col(c).cast("string"))
        gone = staged(chain.where((h("n") > h("to")) & (h("n") > h("from"))).select("n", "from", "to"), "peel-chain")
        cut = inner.join(gone.select(F.col("n").alias("source")), "source", "left_anti").join(gone.select(F.col("n").alias("target")), "target", "left_anti")
        old, left = left, staged(cut.select("source", "target").unionByName(gone.select(F.col("from").alias("source"), F.col("to").alias("target"))).distinct(), "peel")
        dropped(old, inner, gone)


def graph_contract(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations (rule, key): empty or repeated ids, no labels, bad edge types, repeated edge keys, missing ends."""
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), key.cast("string").alias("key"))
    found = rule(nodes.where(F.coalesce(F.trim("id"), F.lit("")) == ""), "EMPTY_ID", F.col("id"))
    found = found.unionByName(rule(nodes.groupBy("id").count().where("count > 1"), "DUPLICATE_ID", F.col("id")))
    found = found.unionByName(rule(nodes.where(F.coalesce(F.size("labels"), F.lit(0)) <= 0), "NO_LABELS", F.col("id")))
    found = found.unionByName(rule(edges.where(~F.coalesce(F.col("type").rlike("^[A-Z][A-Z0-9_]*$"), F.lit(False))), "EDGE_TYPE", F.col("type")))
    if "edge_key" in edges.columns:
        found = found.unionByName(rule(edges.groupBy("edge_key").count().where("count > 1"), "DUPLICATE_EDGE", F.col("edge_key")))
    return found.unionByName(rule(orphan_edges(edges, nodes), "MISSING_END", F.concat_ws(">", "source", "target")))


def shapes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations of the shapes (rule, source, target): hierarchy pairs, domains and ranges, positive article numbers, own siblings in sequences."""
    spark = nodes.sparkSession
    kinds = nodes.select("id", "kind")
    typed = edges.join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("a")), "source", "left").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("b")), "target", "left")
    pairs = spark.createDataFrame([("BELONG_TO", a, b) for a, b in HIERARCHY_PAIRS] + [(t, a, b) for t, ab in SEMANTIC_PAIRS.items() for a, b in ab], "type string, a string, b string")
    ruled = [*SEMANTIC_PAIRS, "BELONG_TO"]
    wrong = typed.where(F.col("type").isin(ruled)).join(F.broadcast(pairs), ["type", "a", "b"], "left_anti").select(F.lit("PAIR").alias("rule"), "source", "target")
    sequence = typed.where(F.col("type").isin("NEXT", "PREVIOUS") & ~F.col("a").eqNullSafe(F.col("b"))).select(F.lit("SEQUENCE_LEVEL").alias("rule"), "source", "target")
    ends = typed.where("a is null or b is null").select(F.lit("MISSING_END").alias("rule"), "source", "target")
    out = wrong.unionByName(sequence).unionByName(ends)
    if "number" in nodes.columns:
        bad = nodes.where((F.col("kind") == "ARTICLE") & ~F.coalesce(F.expr("try_cast(number as int) > 0"), F.lit(False)))
        out = out.unionByName(bad.select(F.lit("ARTICLE_NUMBER").alias("rule"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target")))
    return out


def audit(expected_nodes: int, expected_edges: int, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: expected and actual counts, nodes without edges, and whether the counts agree."""
    counts = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges")))).join(F.broadcast(lone_nodes(nodes, edges).agg(F.count("*").alias("orphans"))))  # one row each
    return counts.select(F.lit(expected_nodes).alias("expected_nodes"), "nodes", F.lit(expected_edges).alias("expected_edges"), "edges", "orphans", ((F.col("nodes") == expected_nodes) & (F.col("edges") == expected_edges)).alias("valid"))


def ungrounded_norms(norms: DataFrame, fused: DataFrame) -> DataFrame:
    """Valid norms whose provenance is in no fused norm's sources (column source_node_ids)."""
    sources = fused.select(F.explode("source_node_ids").alias("provenance_node_id")).distinct()
    return norms.where("status = 'VALID'").join(sources, "provenance_node_id", "left_anti")


def require_empty(df: DataFrame, what: str) -> None:
    """A gate: an error if there is a row."""
    if not df.isEmpty():
        raise ValueError(f"{what}: {[r.asDict() for r in df.limit(5).collect()]}")
