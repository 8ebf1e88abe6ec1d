"""SimHash near-duplicates found by multi-index hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 values (seed 42) of the text's word shingles.
Two fingerprints link if at most `distance` bits differ. The 64 bits are cut into `segments` parts; of two linked
fingerprints some part differs in at most distance // segments bits. Every distinct fingerprint is stored once under each
of its parts, every fingerprint looks up the Hamming ball of that radius around each of its parts, and what it meets is
verified on all 64 bits. That is exact: no link is lost. The number of segments follows from that of the fingerprints:
few and long ones, with larger balls, where chance would fill short ones (`segments_for`).

Copies share a fingerprint and are one row in the search. Fingerprints that crowd into one part (a large group of
near copies) would meet each other in all pairs; parts that hold over `CROWD` fingerprints are therefore compared in
blocks, which return a spanning forest of the links in the block instead of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_names, give_back, small_batches, staged
from .components import components

CROWD = 64
BLOCK = 2048
#: Shingles whose bits are held at a time.
CHUNK = 1 << 17


def fingerprints(texts, shingle: int = 4) -> list[int]:
    """SimHash of each text as a signed 64-bit number; null is an empty text, and no words make zero."""
    hash_of = xxhash.xxh64_intdigest
    ones, sizes, hashes, out = np.zeros(64, np.int64), [], [], []

    def add_up() -> None:
        """Bits of the texts gathered in `hashes`, one after the other."""
        if sizes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            total = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out.extend(_packed(2 * total > np.array(sizes)[:, None]))
            sizes.clear()
            hashes.clear()

    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
        if not words:
            add_up()
            out.append(0)
            continue
        n = min(shingle, len(words))
        line, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        spans = zip(begins[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
        if len(words) <= CHUNK:
            hashes.extend([hash_of(line[a:b], 42) for a, b in spans])
            sizes.append(len(words) - n + 1)
            if len(hashes) >= CHUNK:
                add_up()
            continue
        add_up()
        ones[:], count, part = 0, len(words) - n + 1, []
        for a, b in spans:
            part.append(hash_of(line[a:b], 42))
            if len(part) == CHUNK:
                ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                part = []
        if part:
            ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.extend(_packed((2 * ones > count)[None, :]))
    add_up()
    return out


def _packed(bits: np.ndarray) -> list[int]:
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel().tolist()


def simhash(text: str, shingle: int) -> F.Column:
    """The fingerprint of a text column as a long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(fingerprints(batch, shingle), dtype="int64")
        give_back()

    return of(text)


def segments_for(n: int, distance: int) -> int:
    """The number of segments with the least work for n fingerprints: lookups, each with what chance puts in its bucket."""

    def work(segments: int) -> float:
        width = 64 / segments
        return segments * sum(comb(int(width), k) for k in range(distance // segments + 1)) * (1 + n / 2**width)

    return min(range(min(2, distance + 1), distance + 2), key=lambda s: (work(s), s))


def _masks(bits: int, begin: int, radius: int) -> list[int]:
    """All numbers with up to `radius` of the `bits` bits from `begin` on, as signed 64-bit numbers."""
    return [_signed(sum(1 << b for b in at)) for k in range(radius + 1) for at in combinations(range(begin, begin + bits), k)]


def near(prints: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """Distinct fingerprints (column fp) to rows (a, b) whose components are those of the links within `distance` bits."""
    segments = segments or segments_for(prints.count(), distance)
    radius = distance // segments
    cuts = [64 * i // segments for i in range(segments + 1)]
    part = lambda i, x: F.shiftrightunsigned(x, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    key = lambda i, x: part(i, x) + F.lit(i << 56)
    fp = F.col("fp")
    stored = prints.select("fp", F.explode(F.array(*[key(i, fp) for i in range(segments)])).alias("key"))
    ball = lambda i: F.transform(F.array(*[F.lit(m) for m in _masks(cuts[i + 1] - cuts[i], cuts[i], radius)]), lambda m: key(i, fp.bitwiseXOR(m)))
    asked = prints.select(F.col("fp").alias("of"), F.explode(F.concat(*map(ball, range(segments)))).alias("key"))
    crowds = staged(stored.groupBy("key").count().where(F.col("count") > CROWD).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "simhash-crowds")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("of"))) <= distance
    # Spark takes exploded tables for as small as before; neither is one to broadcast
    thin = stored.join(crowds, "key", "left_anti").join(asked.hint("merge"), "key").where("of < fp").where(close).select(F.col("of").alias("a"), F.col("fp").alias("b"))
    if crowds.isEmpty():
        return thin

    # a crowd's fingerprints are dealt into blocks; the askers too, about as many for each
    n_asked = asked.join(crowds, "key").groupBy("key", "blocks").count().select("key", "blocks", F.ceil(F.col("count") / BLOCK).cast("int").alias("rows"))
    n_asked = staged(n_asked, "simhash-askers")
    one = stored.join(n_asked, "key").withColumns({"at": F.pmod(F.xxhash64("fp", F.lit(1)), "blocks"), "to": F.explode(F.sequence(F.lit(0), F.col("rows") - 1))})
    two = asked.join(n_asked, "key").withColumns({"to": F.pmod(F.xxhash64("of", F.lit(2)), "rows"), "at": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    both = one.select("key", F.col("at").cast("long"), F.col("to").cast("long"), "fp", F.lit(True).alias("is_stored")).unionByName(two.select("key", F.col("at").cast("long"), F.col("to").cast("long"), F.col("of").alias("fp"), F.lit(False).alias("is_stored")))

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        held, asks = (rows.loc[rows.is_stored == x, "fp"].to_numpy("int64").view("uint64") for x in (True, False))
        a, b = _forest(held, asks, distance)
        return pd.DataFrame({"a": a.view("int64"), "b": b.view("int64")})

    return thin.unionByName(both.groupBy("key", "at", "to").applyInPandas(forest, "a long, b long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(held: np.ndarray, asks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to a smallest member that join what links in the bipartite block join."""
    both = np.unique(np.concatenate([held, asks]))
    label = np.arange(len(both))
    h, a = np.searchsorted(both, held), np.searchsorted(both, asks)
    steps = [slice(i, i + 256) for i in range(0, len(a), 256)]
    while len(h) and len(a):
        was = label.copy()
        for s in steps:
            near_by = np.bitwise_count(asks[s, None] ^ held[None, :]) <= distance
            low = np.where(near_by, label[h][None, :], len(both)).min(axis=1)
            label[a[s]] = np.minimum(label[a[s]], low)
            down = np.where(near_by, label[a[s]][:, None], len(both)).min(axis=0)
            np.minimum.at(label, h, down)
        label = np.minimum(label, label[label])
        if (label == was).all():
            break
    own = label != np.arange(len(both))
    return both[label[own]], both[own]


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id, root), one for each row of `docs`.

    component_id: smallest doc_id among the texts reachable by links (null ids count last; null if there is no other);
    root: the component's smallest fingerprint, a key that is never null. Null and blank texts have the fingerprint zero
    and link like any other; repeated rows are in one component; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), simhash(text_col, shingle).alias("fp")), "simhash-rows")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(near(prints.select("fp"), distance, segments), "simhash")
    roots = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    known = staged(roots.select("fp", "root").join(least, "root"), "simhash-roots")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id", "root")


def deduplicated(docs: DataFrame, shingle: int = 5, distance: int = 4, segments: int | None = None) -> DataFrame:
    """`docs` with one row of each near-duplicate group: the smallest doc_id, of equal ids the first text and row.

    Keeps all columns. The choice is made on (doc_id, hash of the row) by an aggregation, so a large group is no task's.
    Fingerprints are made once; the rows are joined by their own hash.
    """
    small_batches(docs.sparkSession)
    names, (row, fp) = docs.columns, free_names(docs, "row", "fp")
    keyed = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("h")))
    told = staged(keyed.select(F.col(row).alias("row"), simhash("text", shingle).alias("fp")), "dedup-rows")
    prints = staged(told.groupBy("fp").agg(F.min("row").alias("least")), "dedup-distinct")
    dropped(told)
    linked = components(near(prints.select("fp"), distance, segments), "dedup")
    best = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias(row)).select(row)
    chosen = staged(best, "dedup-best")
    dropped(prints, linked)
    return keyed.join(chosen, row, "left_semi").dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in names])
