"""Numbered outlines to trees: classify lines, cut segments, find parents, make ids.

The stack of a sequential parser is a set of running maxima here: the parent of a line is the nearest earlier one of
smaller depth, so the latest earlier line of each depth, kept by windows over the document, holds all that is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..schemas import DEPTHS
from ..session import partitions

TYPES = list(DEPTHS)
# Patterns by type, in order; each has the groups (number or marker, title or text) that it names.
PATTERNS = {
    "CHAPTER": [(r"^\s*Ch[uư]ơng\s+([IVXivxLCDMlcdm]+)\s*$", "number", None), (r"^\s*Ch[uư]ơng\s+(\d+)\s*$", "number", None), (r"^\s*CH[UƯ]ƠNG\s+([IVXivx\d]+)\s*$", "number", None)],
    "SECTION": [(r"^\s*M[uụ]c\s+(\d+)\s*$", "number", None), (r"^\s*M[uụ]c\s+([IVXivx]+)\s*$", "number", None)],
    "ARTICLE": [(r"^\s*(?:Đ|Ð)i[eề]u\s+(\d+)\.?\s*(.*)$", "number", "title"), (r"^\s*(?:Đ|Ð)I[EỀ]U\s+(\d+)\.?\s*(.*)$", "number", "title")],
    "CLAUSE": [(r"^\s*(\d+)\.\s+(.+)$", "number", "text"), ("STYLE", None, "text"), (r"^\s*Kho[aả]n\s+(\d+)\.?\s*(.*)$", "number", "text"), (r"^\s*\((\d+)\)\s+(.*)$", "number", "text")],
    "POINT": [(r"^\s*([a-zđ])\)\s+(.+)$", "marker", "text"), ("STYLE", None, "text"), (r"^\s*([a-zđ])\.\s+(.+)$", "marker", "text")],
}
SHORT = {"CHAPTER": "chuong", "SECTION": "muc", "ARTICLE": "dieu", "CLAUSE": "khoan", "POINT": "diem"}
STYLE_HINTS = {"Heading 1": "CHAPTER", "Heading1": "CHAPTER", "Heading 2": "ARTICLE", "Heading2": "ARTICLE"}
LIST_STYLE = "ListParagraph"
#: Lines that a task sorts, on average, in every window over a document.
LINES = 100_000
MATCH = "STRUCT<type: STRING, number: STRING, marker: STRING, title: STRING, text: STRING>"


def depth_of(type_: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv])[type_]


def numbering_hint(ilvl: Column, num_fmt: Column) -> Column:
    return F.when((ilvl == 0) & (num_fmt == "decimal"), "CLAUSE").when((ilvl == 1) & (num_fmt == "lowerLetter"), "POINT")


def _match(type_: str, line: Column, styled: Column) -> Column:
    """The first pattern of a type that fits, as a struct; null if none does."""
    tries = []
    for pattern, name, rest in PATTERNS[type_]:
        if pattern == "STYLE":
            fits, named, body = styled & (line != ""), {}, line
        else:
            fits = line.rlike(pattern)
            named = {name: F.regexp_extract(line, pattern, 1)}
            body = F.regexp_extract(line, pattern, 2) if rest else None
        values = {"number": None, "marker": None, "title": None, "text": None} | named | ({rest: body} if rest else {})
        tries.append(F.when(fits, F.struct(F.lit(type_).alias("type"), *[(F.lit(None) if v is None else v).cast("string").alias(k) for k, v in values.items()])))
    return F.coalesce(*tries)


def ordered_types(hint: Column, scope: Column) -> Column:
    """The order in which types are tried: the hint first; inside an article clauses and points; inside a clause points."""
    first = {t: [t, *(x for x in TYPES if x != t)] for t in TYPES}
    chosen = None
    for t in TYPES:
        cond = hint == t
        chosen = F.when(cond, F.array(*map(F.lit, first[t]))) if chosen is None else chosen.when(cond, F.array(*map(F.lit, first[t])))
    chosen = chosen.when(scope == "ARTICLE", F.array(*map(F.lit, ["CLAUSE", "POINT", "CHAPTER", "SECTION", "ARTICLE"])))
    chosen = chosen.when(scope == "CLAUSE", F.array(*map(F.lit, first["POINT"])))
    return chosen.otherwise(F.array(*map(F.lit, TYPES)))


def dealt(paragraphs: DataFrame) -> DataFrame:
    """Documents in as many partitions as their lines ask for: the windows that follow sort as much a task in tables of all sizes."""
    return paragraphs.repartition(partitions(paragraphs.count(), LINES), "doc")


def classify(paragraphs: DataFrame) -> DataFrame:
    """`paragraphs` (doc, index, text, word_style, ilvl, num_fmt, number, marker) with `match`.

    The scope of a line (the last article or clause; a chapter or section clears it) only reorders the types. Patterns of
    different types exclude each other, but for the list style, which fits any line as a clause or a point. So lines are
    matched without scope, the scope comes from those matches, and only lines in list style are matched once more.
    """
    paragraphs = dealt(paragraphs)
    line = F.trim("text")
    style = F.replace(F.coalesce("word_style", F.lit("")), F.lit(" "), F.lit(""))
    by_number = numbering_hint(F.col("ilvl"), F.col("num_fmt"))
    hint = F.coalesce(by_number, F.create_map(*[F.lit(x) for kv in STYLE_HINTS.items() for x in kv])[F.col("word_style")])
    listed = style == LIST_STYLE
    fits = paragraphs.withColumns({"__line": line, "__hint": hint, "__number_hint": by_number, "__listed": listed})
    for t in TYPES:
        fits = fits.withColumn(f"__{t}", _match(t, F.col("__line"), F.col("__listed") | F.coalesce(F.col("__number_hint") == t, F.lit(False))))

    def first_in(order: Column) -> Column:
        found = F.create_map(*[x for t in TYPES for x in (F.lit(t), F.col(f"__{t}"))])
        return F.get(F.filter(F.transform(order, lambda t: found[t]), lambda m: m.isNotNull()), F.lit(0))

    fits = fits.withColumn("__first", F.when(F.col("__line") != "", first_in(ordered_types(F.col("__hint"), F.lit(None).cast("string")))))
    before = Window.partitionBy("doc").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("__first.type")
    scope = F.last(F.when(opens.isin("ARTICLE", "CLAUSE"), opens).when(opens.isin("CHAPTER", "SECTION"), ""), ignorenulls=True).over(before)
    fits = fits.withColumn("__scope", scope)
    match = F.when(F.col("__line") != "", first_in(ordered_types(F.col("__hint"), F.col("__scope"))))
    return fits.withColumn("match", match).drop("__line", "__hint", "__number_hint", "__listed", "__first", "__scope", *[f"__{t}" for t in TYPES])


def with_contract_metadata(classified: DataFrame) -> DataFrame:
    """Numbers and markers that the source gives override those of the patterns."""
    m = F.col("match")
    return classified.withColumn("match", F.when(m.isNotNull(), F.struct(m["type"].alias("type"), F.coalesce("number", m["number"]).alias("number"), F.coalesce("marker", m["marker"]).alias("marker"), m["title"].alias("title"), m["text"].alias("text"))))


def with_markers(paragraphs: DataFrame) -> DataFrame:
    """Texts whose marker was moved to a column get it back at the front."""
    missing = F.col("marker").isNotNull() & ~F.startswith(F.col("text"), F.concat("marker", F.lit(")")))
    return paragraphs.withColumn("text", F.when(missing, F.concat("marker", F.lit(") "), F.col("text"))).otherwise(F.col("text")))


def boundaries(classified: DataFrame) -> DataFrame:
    """One row for each match: (doc, start_idx, end_idx, char_start, match, word_style, content).

    A match opens a segment that ends before the next; lines without a match that are not blank are its content; lines
    before the first match belong to nothing.
    """
    order = Window.partitionBy("doc").orderBy("index")
    rows = classified.withColumns(
        {
            "segment": F.sum(F.col("match").isNotNull().cast("int")).over(order),
            "char_start": F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "last_idx": F.max("index").over(Window.partitionBy("doc")),
        }
    )
    content = F.when(F.col("match").isNull() & ~T.blank("text"), F.struct("index", "text"))
    cut = rows.where("segment > 0").groupBy("doc", "segment").agg(
        F.min("index").alias("start_idx"),
        F.min_by("char_start", "index").alias("char_start"),
        F.min_by("match", "index").alias("match"),
        F.min_by("word_style", "index").alias("word_style"),
        F.transform(F.array_sort(F.collect_list(content)), lambda x: x["text"]).alias("content"),
        F.max("last_idx").alias("last_idx"),
    )
    after = F.lead("start_idx").over(Window.partitionBy("doc").orderBy("start_idx"))
    return cut.withColumn("end_idx", F.coalesce(after, F.col("last_idx") + 1)).drop("last_idx", "segment")


def of_type(cut: DataFrame, type_: str) -> DataFrame:
    """Boundaries of one type."""
    return cut.where(F.col("match.type") == type_)


def between(cut: DataFrame, start: int, end: int) -> DataFrame:
    """Boundaries that begin in [start, end)."""
    return cut.where((F.col("start_idx") >= start) & (F.col("start_idx") < end))


def hierarchy(cut: DataFrame) -> DataFrame:
    """With depth, parent_idx (start of the parent) and position among the siblings of a type."""
    order = Window.partitionBy("doc").orderBy("start_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("depth", depth_of(F.col("match.type")))
    for d in range(4):
        rows = rows.withColumn(f"__at{d}", F.max(F.when(F.col("depth") == d, F.col("start_idx"))).over(before))
    parent = None
    for d in range(1, 5):
        nearest = F.greatest(*[F.col(f"__at{k}") for k in range(d)]) if d > 1 else F.col("__at0")
        parent = F.when(F.col("depth") == d, nearest) if parent is None else parent.when(F.col("depth") == d, nearest)
    rows = rows.withColumn("parent_idx", parent).drop(*[f"__at{d}" for d in range(4)])
    siblings = Window.partitionBy("doc", "parent_idx", "match.type").orderBy("start_idx")
    return rows.withColumn("position", F.row_number().over(siblings))


def nodes(tree: DataFrame, law_prefix: str = "law", law_code: str | None = None) -> DataFrame:
    """The 17 columns of a node. An id is the suffixes of all ancestors and its own, and the place of its first character.

    The parent of a line is the last earlier one of smaller depth, so the paths of a level are the last paths of the
    levels above: one window for each level over the same order, without a join or another shuffle.
    """
    m = F.col("match")
    marker = F.coalesce(F.when(m["type"] == "POINT", m["marker"]).otherwise(m["number"]), m["number"], m["marker"])
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])[m["type"]]
    slug = F.when(marker.isNotNull() & (marker != ""), T.marker_slug(marker)).otherwise(F.col("position").cast("string"))
    before = Window.partitionBy("doc").orderBy("start_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = tree.withColumn("suffix", F.concat(short, F.lit("-"), slug))
    own = lambda path: F.struct(path.alias("path"), F.concat(F.lit(law_prefix + "_"), path, F.lit("_p"), F.col("char_start").cast("string")).alias("id"))
    rows = rows.withColumn("__own", F.when(F.col("depth") == 0, own(F.col("suffix")))).withColumn("parent_id", F.lit(None).cast("string"))
    for d in range(1, 5):
        rows = rows.withColumn("__up", F.last(F.when(F.col("depth") < d, F.col("__own")), ignorenulls=True).over(before))
        here = F.col("depth") == d
        path = F.concat_ws("_", F.col("__up.path"), "suffix")
        rows = rows.withColumns({"parent_id": F.when(here, F.col("__up.id")).otherwise(F.col("parent_id")), "__own": F.when(here, own(path)).otherwise(F.col("__own"))})
    named = rows.withColumn("id", F.col("__own.id"))
    full = _with_children(named)
    body = F.array_join(F.filter(F.concat(F.array(m["text"]), F.col("content")), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")
    orphan = (m["type"] == "POINT") & F.coalesce(F.contains("parent_id", F.lit("_dieu-")) & ~F.contains("parent_id", F.lit("_khoan-")), F.lit(False))
    return full.select(
        "id", m["type"].alias("type"), "depth", F.nullif(F.trim(m["title"]), F.lit("")).alias("title"), body.alias("text"), "parent_id",
        F.coalesce("children_count", F.lit(0)).alias("children_count"), "position", m["number"].alias("number"), m["marker"].alias("marker"),
        F.lit(law_prefix).alias("law_prefix"), F.lit(law_code).cast("string").alias("law_code"), F.col("doc").cast("string").alias("source_doc"), "word_style", "start_idx", "end_idx", orphan.alias("implicit_parent"),
    )


def _with_children(rows: DataFrame) -> DataFrame:
    """With children_count: each row tells its parent's place of itself by a row that is empty otherwise, in the same partition."""
    tells = F.when(F.col("parent_idx").isNotNull(), F.array(F.struct(F.lit(True).alias("own"), F.col("start_idx").alias("at")), F.struct(F.lit(False).alias("own"), F.col("parent_idx").alias("at"))))
    told = rows.withColumn("__t", F.explode(F.coalesce(tells, F.array(F.struct(F.lit(True).alias("own"), F.col("start_idx").alias("at"))))))
    told = told.select("doc", F.col("__t.own").alias("__own_row"), F.col("__t.at").alias("__at"), *[F.when(F.col("__t.own"), F.col(c)).alias(c) for c in rows.columns if c != "doc"])
    n = F.count_if(~F.col("__own_row")).over(Window.partitionBy("doc", "__at")).cast("int")
    return told.withColumn("children_count", n).where("__own_row").drop("__own_row", "__at")


def parse(paragraphs: DataFrame, law_prefix: str = "law", law_code: str | None = None) -> DataFrame:
    """Structured paragraphs to nodes."""
    return nodes(hierarchy(boundaries(with_contract_metadata(classify(with_markers(paragraphs))))), law_prefix, law_code)


def parse_text(lines: DataFrame, law_prefix: str = "law", law_code: str | None = None) -> DataFrame:
    """Rows (doc, idx, line) to nodes."""
    none = {"word_style": "string", "num_id": "int", "ilvl": "int", "num_fmt": "string", "number": "string", "marker": "string"}
    return parse(lines.select("doc", F.col("idx").alias("index"), F.col("line").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]), law_prefix, law_code)


def stats(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("type").agg(F.count("*").alias("n"))


def checked_ids(parsed: DataFrame) -> DataFrame:
    """`parsed`, or an error while it is read if two nodes have one id."""
    n = F.count("*").over(Window.partitionBy("id"))
    checked = parsed.withColumn("__n", n)
    return checked.withColumn("id", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("id collision: "), F.col("id")))).otherwise(F.col("id"))).drop("__n")


def position_gaps(tree: DataFrame) -> DataFrame:
    """Siblings whose positions are not consecutive."""
    order = Window.partitionBy("parent_id", "type").orderBy("position")
    return tree.withColumn("next", F.lead("position").over(order)).where(F.col("next") - F.col("position") > 1).select("parent_id", "type", F.col("position").alias("after"), F.col("next").alias("before"))
