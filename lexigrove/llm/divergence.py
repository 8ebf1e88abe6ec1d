"""How far the sources of a language lie apart, by joint histograms of term counts.

A term's share in a group (lang, source) of documents is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), with N the counts of all
V kept terms there; two shares are f = floor((p - q)^2 / (p + q)) apart. f depends on the two counts alone, so for a pair of
sources only a histogram is kept: how many terms have count a in the one and count b in the other. Cells where both counts
are positive are tallied in buckets of terms; cells with a zero follow from the histograms of the single sources, since the
terms with count a that the other source lacks are those with count a less those that it shares, and the terms that neither
has are what is left of V. f is evaluated once for each cell and multiplied by the number of terms in it.

Texts leave the first step as counts of distinct terms; what is shuffled grows with the vocabulary, not with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, give_back, small_batches, staged

SCALE = 1_000_000_000
#: Bytes of text whose terms are counted at a time, and kept counts in a bucket of the joint histograms.
SLICE, BUCKET = 8 << 20, 1 << 14


def _folded() -> np.ndarray:
    """By byte: what it is in a term, zero for what ends one. A to Z are lower-cased; bytes beyond ASCII stay."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for first in (ord("A"), ord("a")):
        table[first : first + 26] = np.arange(ord("a"), ord("a") + 26)
    return table


FOLDED = _folded()


def terms(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(terms of all texts one after the other, the number of the text of each); no text is null."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    octets = FOLDED[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    if not octets.any():
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    inside = octets != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1] - bounds[0]
    edges = edges[edges < len(octets)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    held = octets[inside]
    offsets = np.append((np.cumsum(inside) - 1)[starts], len(held)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(held.tobytes()))
    return found, np.searchsorted(bounds - bounds[0], starts, "right") - 1


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls to (lang, source, term, n, docs), summed up by slices of texts only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(sizes):
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, "right")))
                langs, sources = (batch.column(c).slice(begin, end - begin).dictionary_encode() for c in (0, 1))
                found, doc = terms(batch.column(2).slice(begin, end - begin))
                begin = end
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                many = len(coded.dictionary)
                in_doc, n = np.unique(doc * many + coded.indices.to_numpy(), return_counts=True)
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                key, at = np.unique(group[in_doc // many] * many + in_doc % many, return_inverse=True)
                group, term = key // many, key % many
                columns = [
                    langs.dictionary.take(pa.array(group // len(sources.dictionary))),
                    sources.dictionary.take(pa.array(group % len(sources.dictionary))),
                    coded.dictionary.take(pa.array(term)),
                    pa.array(np.bincount(at, n).astype(np.int64)),
                    pa.array(np.bincount(at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        give_back()

    return docs.mapInArrow(read, "lang string, source string, term string, n long, docs long")


def joint_histogram(counts: DataFrame, rows: int, bucket: int = BUCKET) -> DataFrame:
    """Counts (lang, source, term, n) to cells (lang, a, b, count_a, count_b, terms) of the pairs a < b where both are positive.

    Each bucket of terms is tallied by itself and sends its cells, never its pairs of rows.
    """

    def tallied(key: tuple, table: pa.Table) -> pa.Table:
        names = sorted(set(table.column("source").to_pylist()), key=lambda s: s.encode())
        source = np.array(pc.index_in(table.column("source").combine_chunks(), pa.array(names, pa.string())))
        term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        value, count = np.unique(table.column("n").to_numpy(), return_inverse=True)
        many, cells = len(value), []
        order = np.argsort(source, kind="stable")
        source, term, count = source[order], term[order], count[order]
        bounds = np.searchsorted(source, np.arange(len(names) + 1))
        own = np.zeros(int(term.max()) + 1, np.int64)
        for a in range(len(names) - 1):
            own[:] = -1
            own[term[bounds[a] : bounds[a + 1]]] = count[bounds[a] : bounds[a + 1]]
            rest = slice(bounds[a + 1], None)  # the rows of all later sources
            mine = own[term[rest]]
            both = mine >= 0
            cell, n = np.unique((source[rest][both].astype(np.int64) * many + mine[both]) * many + count[rest][both], return_counts=True)
            cells.append((np.full(len(cell), a), cell // many // many, cell // many % many, cell % many, n))
        a, b, x, y, n = (np.concatenate([c[i] for c in cells]) if cells else np.zeros(0, np.int64) for i in range(5))
        named = pa.array(names, pa.string())
        lang = pa.array([key[0].as_py()] * len(a), pa.string())
        return pa.table([lang, named.take(pa.array(a)), named.take(pa.array(b)), pa.array(value[x]), pa.array(value[y]), pa.array(n)], ["lang", "a", "b", "count_a", "count_b", "terms"])

    buckets = max(1, -(-rows // bucket))
    dealt = counts.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    cells = dealt.groupBy("lang", "bucket").applyInArrow(tallied, "lang string, a string, b string, count_a long, count_b long, terms long")
    return cells.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("terms").alias("terms"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact."""
    top = (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, bucket: int = BUCKET, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each group (lang, source) of `docs`.

    Part `pair`: item is another source of the language, value the sum of f over the kept terms (0 where none is kept).
    Part `term`: item is a kept term whose share here is above its share in the language, value its f; the `top` largest.
    Kept are terms in at least `min_docs` documents of their language. Ranks count from 1, larger values first, then items
    by their bytes. Null texts, languages and sources are empty strings; a source without terms is a group as well; repeated
    rows count each; other columns play no part; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups = staged(own.select("lang", "source").distinct(), "divergence-groups")
    by_term = Window.partitionBy("lang", "term")
    counts = counted(own).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumns({"in_docs": F.sum("docs").over(by_term), "lang_n": F.sum("n").over(by_term)})
    counts = staged(counts.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"), "divergence-counts")
    # one row a language, and one a group
    kept = counts.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups_of = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups_of = staged(groups_of.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "held", "kept", "lang_total")]), "divergence-totals")

    cells = staged(joint_histogram(counts, counts.count(), bucket), "divergence-cells")
    side = lambda x: groups_of.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), F.col("held").alias(f"held_{x}"), *(["kept"] if x == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("a < b")  # the result has a row for each
    zero, shared = F.lit(0).cast("long"), ["lang", "a", "b"]
    single = counts.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("terms"))
    names = pairs.select(*shared)
    of_a = single.select("lang", F.col("source").alias("a"), F.col("count").alias("count_a"), zero.alias("count_b"), "terms").join(names, ["lang", "a"])
    of_b = single.select("lang", F.col("source").alias("b"), zero.alias("count_a"), F.col("count").alias("count_b"), "terms").join(names, ["lang", "b"])
    rows = cells
    for part in (
        of_a,
        of_b,
        cells.withColumns({"count_b": zero, "terms": -F.col("terms")}),
        cells.withColumns({"count_a": zero, "terms": -F.col("terms")}),
        cells.withColumns({"count_a": zero, "count_b": zero}),
        pairs.select(*shared, zero.alias("count_a"), zero.alias("count_b"), (F.col("kept") - F.col("held_a") - F.col("held_b")).alias("terms")),
    ):
        rows = rows.unionByName(part)
    table = rows.groupBy(*shared, "count_a", "count_b").agg(F.sum("terms").alias("terms")).where("terms > 0").join(pairs, shared)
    f = apart(share(F.col("count_a"), F.col("total_a"), F.col("kept")), share(F.col("count_b"), F.col("total_b"), F.col("kept")))
    values = table.groupBy(*shared).agg(F.sum(f * F.col("terms")).alias("value"))
    values = names.join(values, shared, "left").withColumn("value", F.coalesce("value", zero))
    both = values.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    largest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    between = both.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(largest))

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = counts.join(groups_of, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    above = above.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= top)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    out = staged(named(between, "pair").unionByName(named(above, "term")), "divergence")
    dropped(groups, counts, groups_of, cells)
    return out
