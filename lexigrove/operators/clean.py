"""Cleaning and formatting of lines.

Lines are rows (doc, idx, line). Everything that looks at neighbours is a window over one document, so documents are
spread over the cluster and no window is global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

def _by_line():
    return Window.partitionBy("doc").orderBy("idx")


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts to rows (doc, idx, line)."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("idx", "line"))


def clean_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", T.clean_line("line"))


def merge_dangling(lines: DataFrame, dangles=T.is_dangling) -> DataFrame:
    """A line that is only a marker takes the next line that is not blank.

    Within a run of such lines every second one is taken by the one before, and so is the line after a run of odd
    length; that is the parity of the distance to the last line that is no marker.
    """
    full = lines.where(~T.blank("line"))
    order = Window.partitionBy("doc").orderBy("idx")
    full = full.withColumns({"n": F.row_number().over(order), "dangles": dangles("line"), "next": F.lead("line").over(order)})
    last = F.max(F.when(~F.col("dangles"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumn("taken", (F.col("n") - 1 - F.coalesce(last, F.lit(0))) % 2 == 1)
    merged = F.when(F.col("dangles") & F.col("next").isNotNull(), F.concat_ws(" ", F.trim("line"), F.trim("next"))).otherwise(F.col("line"))
    kept = full.where(~F.col("taken")).select("doc", "idx", merged.alias("line"))
    return kept.unionByName(lines.where(T.blank("line")).select("doc", "idx", "line"))


def drop_noise(lines: DataFrame) -> DataFrame:
    return lines.where(~T.is_noise("line"))


def cleaned(lines: DataFrame) -> DataFrame:
    return drop_noise(merge_dangling(clean_lines(lines)))


def next_full_line(lines: DataFrame) -> DataFrame:
    """With `next_idx`: the place of the next line that is not blank."""
    after = _by_line().rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("next_idx", F.first(F.when(~T.blank("line"), F.col("idx")), ignorenulls=True).over(after))


def normalized(lines: DataFrame) -> DataFrame:
    """NFC, with the number of characters changed."""
    return lines.withColumn("__n", T.nfc_changes("line")).withColumns({"line": F.col("__n.text"), "changed": F.col("__n.changed")}).drop("__n")


def normalization_stats(lines: DataFrame) -> DataFrame:
    return normalized(lines).agg(F.count("*").alias("total_lines"), F.count_if(F.col("changed") > 0).alias("changed_lines"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed_chars"))


def separate_structure(lines: DataFrame) -> DataFrame:
    """A blank line before each structural line that follows a line that is not blank."""
    before = F.lag("line").over(_by_line())
    needs = T.is_structural("line") & before.isNotNull() & (before != "")
    parts = F.when(needs, F.array(F.lit(""), F.col("line"))).otherwise(F.array("line"))
    wide = lines.withColumn("__parts", parts).select("doc", "idx", F.posexplode("__parts").alias("__at", "line"))
    return wide.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("idx", "__at")) - 1).drop("__at")


def collapse_blanks(lines: DataFrame) -> DataFrame:
    """The first of each run of blank lines stays, as an empty line."""
    marked = lines.withColumn("__before", F.coalesce(T.blank(F.lag("line").over(_by_line())), F.lit(False)))
    return marked.where(~(T.blank("line") & F.col("__before"))).select("doc", "idx", F.when(T.blank("line"), F.lit("")).otherwise(F.col("line")).alias("line"))


def formatted(lines: DataFrame) -> DataFrame:
    """One text a document: structure on lines of its own, single blank lines, one line end at the end."""
    done = collapse_blanks(separate_structure(lines.withColumn("line", F.trim("line"))))
    joined = done.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return joined.select("doc", F.concat(F.regexp_replace(text, r"^\s+|\s+\z", ""), F.lit("\n")).alias("text"))


def clean_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts to cleaned, normalized and formatted texts."""
    return formatted(normalized(cleaned(lines_of(docs, doc, text))).drop("changed"))
