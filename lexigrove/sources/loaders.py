"""Sources: text and DOCX documents as paragraphs, JSON graphs, embeddings, rule tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import EXTRACTION, NODE, PARAGRAPH

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A point's marker after the end of a clause or list item begins a line of its own.
INLINE_POINT = r"(?<=[;.:])\s+(?=[a-zđ]\)\s+)"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs (schema PARAGRAPH) of a .docx or .txt file, or of a glob of such files."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "docx":
        return checked_contract(docx(spark, path))
    if kind == "txt":
        return checked_contract(text(spark, path))
    raise ValueError(f"neither .docx nor .txt: {path}")


def text(spark: SparkSession, path: str) -> DataFrame:
    """One row a line; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.regexp_replace("value", r"\R\z", "").alias("value"))
    lines = files.select("doc", F.posexplode(F.split("value", r"\R")).alias("index", "text"))
    return structured(lines)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, index, text): the lines of text files without their ends, blank ones too."""
    return text(spark, path).select("doc", "index", F.regexp_replace("text", r"[\r\n]+\z", "").alias("text"))


def filled_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(doc, index, text, word_style, ilvl): paragraphs that are not blank, with the index that they have among all."""
    return paragraphs.where(F.trim("text") != "").select("doc", "index", "text", "word_style", "ilvl")


def checked_contract(paragraphs: DataFrame) -> DataFrame:
    """`paragraphs`, or an error while they are read if one has both a number and a marker."""
    both = F.col("number").isNotNull() & F.col("marker").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("a paragraph has a number and a marker: "), F.col("doc"), F.lit(" "), F.col("index").cast("string")))
    return paragraphs.withColumn("number", F.when(both, wrong.cast("string")).otherwise(F.col("number")))


def structured(lines: DataFrame) -> DataFrame:
    """Rows (doc, index, text) as paragraphs without metadata."""
    none = {"word_style": "string", "num_id": "int", "ilvl": "int", "num_fmt": "string", "number": "string", "marker": "string"}
    return lines.select("doc", F.col("index").cast("int").alias("index"), "text", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], (F.trim("text") == "").alias("is_empty"))


def docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of DOCX files. The XML is read by an Arrow map on one file at a time; numbers are counted by windows."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content").mapInPandas(_paragraphs, "doc string, index int, text string, word_style string, num_id int, ilvl int, num_fmt string, lvl_text string, start int, broken boolean")
    bad = raw.where("broken").select("doc", F.raise_error(F.concat(F.lit("no DOCX file: "), F.col("doc"))).cast("int").alias("index"))
    good = numbered(raw.where("not broken"))
    out = split_points(good)
    return out.unionByName(bad, allowMissingColumns=True).select(*[c.split()[0] for c in PARAGRAPH.split(", ")])


def _paragraphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc", "index", "text", "word_style", "num_id", "ilvl", "num_fmt", "lvl_text", "start", "broken"]
    for f in frames:
        rows = []
        for doc, content in f.itertuples(index=False):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    levels = _levels(z.read("word/numbering.xml")) if "word/numbering.xml" in z.namelist() else {}
                    body = ElementTree.fromstring(z.read("word/document.xml"))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                rows.append((doc, None, None, None, None, None, None, None, None, True))
                continue
            for i, p in enumerate(body.iter(f"{W}p")):
                style = p.find(f"{W}pPr/{W}pStyle")
                num, lvl = p.find(f"{W}pPr/{W}numPr/{W}numId"), p.find(f"{W}pPr/{W}numPr/{W}ilvl")
                num_id = int(num.get(f"{W}val")) if num is not None else 0
                ilvl = int(lvl.get(f"{W}val")) if lvl is not None else 0
                fmt, label, start = levels.get((num_id, ilvl), (None, None, 1)) if num_id else (None, None, 1)
                rows.append((doc, i, "".join(t.text or "" for t in p.iter(f"{W}t")), style.get(f"{W}val") if style is not None else None, num_id or None, ilvl if num_id else None, fmt, label, start, False))
        yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("index", "num_id", "ilvl", "start")})


def _levels(xml: bytes) -> dict[tuple[int, int], tuple[str, str, int]]:
    """(numId, ilvl) to (format, text, first number): numbers joined to their abstract definitions."""
    root = ElementTree.fromstring(xml)
    value = lambda e, name, default=None: default if (x := e.find(f"{W}{name}")) is None else x.get(f"{W}val")
    abstract = {a.get(f"{W}abstractNumId"): {int(v.get(f"{W}ilvl")): (value(v, "numFmt", "decimal"), value(v, "lvlText", "%1."), int(value(v, "start", 1))) for v in a.findall(f"{W}lvl")} for a in root.findall(f"{W}abstractNum")}
    return {(int(n.get(f"{W}numId")), i): d for n in root.findall(f"{W}num") for i, d in abstract.get(value(n, "abstractNumId"), {}).items()}


def numbered(paragraphs: DataFrame) -> DataFrame:
    """With number or marker of automatic lists. A counter starts anew when a list level above it counts on."""
    order = Window.partitionBy("doc", "num_id").orderBy("index")
    rows = paragraphs
    for level in range(9):
        above = F.sum((F.col("ilvl") < level).cast("int")).over(order)
        rows = rows.withColumn(f"__reset{level}", above)
    reset = F.get(F.array(*[F.col(f"__reset{level}") for level in range(9)]), F.col("ilvl"))
    rows = rows.withColumn("__group", reset).drop(*[f"__reset{level}" for level in range(9)])
    count = F.row_number().over(Window.partitionBy("doc", "num_id", "ilvl", "__group").orderBy("index")) + F.coalesce("start", F.lit(1)) - 1
    rows = rows.withColumn("__count", F.when(F.col("num_id").isNotNull() & F.col("num_fmt").isNotNull(), count))
    letter = F.col("num_fmt").isin("lowerLetter", "upperLetter")
    value = number_text(F.col("num_fmt"), F.col("__count"))
    return rows.withColumns({"number": F.when(~letter, value), "marker": F.when(letter, value), "label": F.when(value.isNotNull(), F.regexp_replace("lvl_text", F.lit(r"%\d"), value))}).drop("__group", "__count")


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999: the digits of each power of ten from a table."""
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    tens = [x.replace("X", "C").replace("V", "L").replace("I", "X") for x in ones]
    hundreds = [x.replace("X", "M").replace("V", "D").replace("I", "C") for x in ones]
    digit = lambda table, power: F.get(F.array(*map(F.lit, table)), (F.floor(n / power) % 10).cast("int"))
    return F.when(n.between(1, 3999), F.concat(digit(["", "M", "MM", "MMM"] + [""] * 6, 1000), digit(hundreds, 100), digit(tens, 10), digit(ones, 1)))


def number_text(num_fmt: Column, n: Column) -> Column:
    """A count in a list's format: decimal, letters (26 and on again) or Roman, of either case."""
    return (
        F.when(num_fmt == "lowerLetter", F.char(F.lit(97) + F.pmod(n - 1, F.lit(26)))).when(num_fmt == "upperLetter", F.char(F.lit(65) + F.pmod(n - 1, F.lit(26))))
        .when(num_fmt == "lowerRoman", F.lower(roman(n))).when(num_fmt == "upperRoman", roman(n)).otherwise(n.cast("string"))
    )


def split_points(paragraphs: DataFrame) -> DataFrame:
    """Points inside a paragraph become rows of their own; the first part keeps the numbering, the others have their marker."""
    parts = F.filter(F.split("text", INLINE_POINT), lambda x: F.trim(x) != "")
    rows = paragraphs.withColumn("__parts", F.when(F.size(parts) > 0, parts).otherwise(F.array("text")))
    rows = rows.select("*", F.posexplode("__parts").alias("__at", "__part")).drop("__parts")
    later = F.col("__at") > 0
    marker = F.regexp_extract("__part", r"^([a-zđ])\)\s+", 1)
    rows = rows.withColumns({"text": F.when(later, F.regexp_replace("__part", r"^[a-zđ]\)\s+", "")).otherwise(F.col("__part")), "marker": F.when(later, marker).otherwise(F.col("marker")), "number": F.when(~later, F.col("number"))})
    for c in ("num_id", "ilvl", "num_fmt"):
        rows = rows.withColumn(c, F.when(~later, F.col(c)))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("index", "__at")) - 1
    return rows.withColumns({"index": place, "is_empty": F.trim("text") == ""}).drop("__at", "__part", "lvl_text", "start", "broken")


def plain_lines(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs as lines, with the label of an automatic number in front."""
    label = F.coalesce("label", F.when(F.col("marker").isNotNull(), F.concat("marker", F.lit(")")))) if "label" in paragraphs.columns else F.when(F.col("marker").isNotNull(), F.concat("marker", F.lit(")")))
    return paragraphs.select("doc", F.col("index").alias("idx"), F.concat_ws(" ", label, "text").alias("line"))


# Tables of other stages.
def nodes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or JSON lines, of parsed nodes; an empty one is an error."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()  # one line
    array = bool(first) and first[0]["value"].lstrip().startswith("[")
    df = spark.read.schema(NODE).option("multiLine", array).json(path)
    if df.isEmpty():
        raise ValueError(f"no nodes in {path}")
    return df


def extractions(spark: SparkSession, path: str) -> DataFrame:
    whole = f"extracted_nodes ARRAY<STRUCT<{', '.join(f'{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}' for c in _columns(EXTRACTION))}>>"
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode("extracted_nodes").alias("n")).select("n.*")


def _columns(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file {nodes: [..], edges: [..]}."""
    df = spark.read.option("multiLine", True).json(path)
    missing = {"nodes", "edges"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} has no {sorted(missing)}")
    return df.select(F.explode("nodes").alias("n")).select("n.*"), df.select(F.explode("edges").alias("e")).select("e.*")


def embeddings(spark: SparkSession, path: str, count: int | None = None, dimension: int | None = None) -> DataFrame:
    """A table (node_id, embedding); rows, distinct ids and length are checked in one pass."""
    df = spark.read.parquet(path)
    s = df.agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("ids"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if s["n"] != s["ids"] or s["low"] != s["high"] or (count is not None and s["n"] != count) or (dimension is not None and s["n"] and s["low"] != dimension):
        raise ValueError(f"embeddings do not fit: {s.asDict()}")
    return df


def calibration_rows(spark: SparkSession, path: str, split: str | None = "train") -> DataFrame:
    """Score, label and split of a CSV file with a header."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = {"score", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} has no {sorted(missing)}")
    df = df.withColumns({"score": F.col("score").cast("double"), "label": F.col("label").cast("int")})
    return df.where(F.col("split") == split) if split and "split" in df.columns else df


def yaml_rules(path: str, key: str) -> list[dict]:
    """A list in a YAML file. Rule files are read on the driver; they are configuration."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)[key]


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rule dictionaries in the order of the file as the table that the rule match takes."""
    rows = [(n, r["id"], r["m6_type"].upper(), [t.lower() for t in r.get("triggers", [])], [t.lower() for t in r.get("negative_triggers", [])], r.get("target_subtype"), r.get("target_concept_id"), r.get("action", "CORRECT"), r.get("confidence", "HIGH"), bool(r.get("head_guard")) or str(r.get("target_concept_id", "")).split(".")[1:2] == ["OBJECT"]) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, m6_type string, triggers array<string>, negative_triggers array<string>, subtype string, concept_id string, action string, confidence string, head_guard boolean")


def trigger_collisions(rules: DataFrame) -> DataFrame:
    """Triggers that more than one rule of a type has."""
    return rules.select("m6_type", "rule_id", F.explode("triggers").alias("trigger")).groupBy("m6_type", "trigger").agg(F.count_distinct("rule_id").alias("n"), F.sort_array(F.collect_set("rule_id")).alias("rules")).where("n > 1")
