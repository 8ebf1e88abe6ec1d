"""One document of each group of near-duplicates: SimHash candidates by multi-index hashing, verified by Jaccard similarity.

Two texts link if their sets of word shingles have a Jaccard similarity of at least `similarity`. Candidates come from
SimHash fingerprints of the distinct shingles, of as many bits as the table's size asks for (`plan`): they are cut into
segments, every fingerprint is stored under each of its segments and looks up the ball of radius 1 around each. At the
similarity in question a bit differs with probability acos(2s / (1 + s)) / pi, 0.15 at 0.8, so a segment of w bits meets with a
known probability, and there are enough segments to find `recall` of the pairs just at the threshold; of closer ones more.
Segments are about log2(n) bits long, so what chance puts into a bucket does not grow with the table. Of two segments that
differ in one bit one has an odd number of ones: only that one looks up its ball, which halves the look-ups. Each look-up
carries one 64-bit word of the fingerprint, not the one its segment is from; what meets and is close in that word is held
against all bits and sizes, then against the texts, of which only those in question are sent.

A segment that very many texts share (a large group of near copies) would give all pairs. So all texts of a bucket are
first held against one of them, and then another, which joins most of such a group at a few comparisons for each member.
Texts that are joined are not compared with each other any more: what is left are those outside the largest group of a
bucket, which look for texts of other groups, the closest of each group first. Only a group of over `CROWD` texts is left out so; the crowds of two
neighbouring buckets are held against each other where they are different groups, so no pair that shares a ball is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_names, give_back, small_batches, staged
from .components import components
from .substring import _mix, _neighbours, _shingles, _slices, _word_hashes

#: Texts of a bucket that all of it is held against, one after the other, before the rest is compared.
STARS = 3
#: A group with more texts than this in a bucket is held against other groups only, never against itself.
CROWD = 32
#: Times that texts are held against the closest of each other group before all others that met are.
CLOSEST = 1
#: Classes whose texts are asked for by a list that is sent to all tasks; more are joined.
SENT = 1 << 20


def plan(n: int, similarity: float, recall: float = 0.95) -> tuple[int, int, int, int]:
    """(bits of a segment, segments, 64-bit words of a fingerprint, most bits that differ) for n texts."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    width = min(30, max(8, ceil(log2(max(2, n))) - 4))
    meets = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    segments = max(2, ceil(log(1 - recall) / log(1 - meets)) if meets < 1 else 1)
    words = ceil(width * segments / 64)
    segments, words = 64 * words // width, 2 * words  # half of the bits are for distances alone: they tell 0.8 from 0.6
    return width, segments, words, int(64 * words * p + 2.5 * sqrt(64 * words * p * (1 - p)))


def prints(shingles: np.ndarray, words: int) -> list[int]:
    """The fingerprint of a set of 64-bit hashes, as signed 64-bit numbers: each bit is the majority's."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(shingles), 1 << 16):
            h = _mix(shingles[i : i + (1 << 16)] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0]))
    return out


def _told_set(told: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, from what `told` keeps of each pair of words."""
    return np.unique(_shingles(np.frombuffer(told, "<u2").astype(np.uint64), shingle - 1))


def described(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    """(none, id, h, text) to (none, id, h, n, d, p0 .., told): shingles, distinct ones, fingerprint, two bytes for each pair of words.

    Texts under `shingle` words have no fingerprint, and `told` holds their words.
    """
    schema = "none boolean, id long, h long, n long, d long, " + ", ".join(f"p{k} long" for k in range(words)) + ", told binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for ids, texts in _slices(batch.select(["id", "text"])):
                own = batch.slice(begin, len(texts))
                begin += len(texts)
                found, bounds = _word_hashes(texts)
                p, d, told = [], [], []
                for s, e in zip(bounds[:-1], bounds[1:]):
                    part = found[s:e]
                    long = len(part) >= shingle
                    p.append(prints(np.unique(_shingles(part, shingle)), words) if long else [0] * words)
                    told.append(_neighbours(part).tobytes() if long else part.tobytes())
                    # of what the check compares
                    d.append(len(_told_set(told[-1], shingle)) if long else 0)
                n = np.maximum(np.diff(bounds) - shingle + 1, 0)
                columns = [own.column(0), own.column(1), own.column(2), pa.array(n, pa.int64()), pa.array(d, pa.int64()), *[pa.array([x[k] for x in p], pa.int64()) for k in range(words)], pa.array(told, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["none", "id", "h", "n", "d", *[f"p{k}" for k in range(words)], "told"])
        give_back()

    return rows.select("none", "id", "h", "text").mapInArrow(read, schema)


def _segment(cols: list[Column], at: int, width: int) -> Column:
    """Bits `at` to `at + width` of the words of a fingerprint."""
    k, b = divmod(at, 64)
    low = F.shiftrightunsigned(cols[k], b)
    both = low if b + width <= 64 else low.bitwiseOR(F.shiftleft(cols[k + 1], 64 - b))
    return both.bitwiseAND(F.lit((1 << width) - 1))


def _verified(pairs: DataFrame, facts: DataFrame, told: DataFrame, words: int, most: int, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes in different groups whose sets of shingles are similar enough.

    facts: (class, d, p0 .., root); told: (class, told). Sets whose sizes are too far apart and fingerprints with too many other
    bits go before any text is sent.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def shingles(key: int, data) -> np.ndarray:
            if key not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[key] = _told_set(data.as_py(), shingle)
            return sets[key]

        for batch in batches:
            good = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                one, two = shingles(a, x), shingles(b, y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both >= similarity * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    of = lambda c: facts.select(F.col("class").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in facts.columns if x != "class"])
    able = F.least("a_d", "b_d") >= similarity * F.greatest("a_d", "b_d")
    close = sum((F.bit_count(F.col(f"a_p{k}").bitwiseXOR(F.col(f"b_p{k}"))) for k in range(words)), F.lit(0)) <= most
    asked = staged(pairs.join(of("a"), "a").join(of("b"), "b").where((F.col("a_root") != F.col("b_root")) & able & close).select("a", "b"), "neardup-pairs")
    ids = staged(asked.select(F.col("a").alias("class")).unionByName(asked.select(F.col("b").alias("class"))).distinct(), "neardup-asked")
    if ids.count() <= SENT:
        told = told.join(F.broadcast(ids), "class", "left_semi")
    named = lambda c: told.select(F.col("class").alias(c), F.col("told").alias(f"{c}_told"))
    return asked.join(named("b"), "b").join(named("a"), "a").select("a", "b", "a_told", "b_told").mapInArrow(check, "a long, b long")


def near_in_a_word(similarity: float) -> int:
    """Bits of 64 in which fingerprints of similar sets differ at most, but for one pair of a thousand at the threshold."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(64 * p + 3.3 * sqrt(64 * p * (1 - p)))


def links(classes: DataFrame, told: DataFrame, width: int, segments: int, words: int, most: int, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of classes (class, d, p0 ..) whose components are those of all verified candidates."""
    p = [F.col(f"p{k}") for k in range(words)]
    near = F.bit_count(F.col("v").bitwiseXOR(F.col("qv"))) <= (near_in_a_word(similarity) if words > 1 else most)
    pair = [F.least("of", "class").alias("a"), F.greatest("of", "class").alias("b"), F.bit_count(F.col("v").bitwiseXOR(F.col("qv"))).alias("bits")]
    # of each segment the key, and a word of the half that no segment is from
    half = max(1, words // 2)
    spread = [F.struct(_segment(p, i * width, width).bitwiseOR(F.lit(i << 32)).alias("key"), p[(half + i % half) % words].alias("v")) for i in range(segments)]
    stored = classes.select("class", F.explode(F.array(*spread)).alias("s")).select("class", "s.key", "s.v")
    found, roots = None, classes.select("class", F.col("class").alias("root"))
    for seed in range(STARS):
        # each bucket is held against one of its texts, another one each time
        first = F.min_by(F.struct(F.col("class").alias("of"), F.col("v").alias("qv")), F.struct(F.xxhash64("class", F.lit(seed)), "class")).alias("first")
        star = stored.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1").select("key", "first.*")
        pairs = stored.join(star.hint("merge"), "key").where("of <> class").where(near).select(*pair[:2]).distinct()
        good = staged(_verified(pairs, classes.join(roots, "class"), told, words, most, shingle, similarity), "neardup-star")
        found = good if found is None else found.unionByName(good)
        linked = components(found, "neardup-first").withColumnRenamed("node", "class")
        before, roots = roots, staged(classes.select("class").join(linked, "class", "left").select("class", F.coalesce("root", "class").alias("root")), "neardup-roots")
        dropped(before)
    # who is in a large group of a bucket, its largest, need not be met there by others of it
    stored = stored.join(roots, "class")
    groups = stored.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("largest"))
    groups = staged(groups, "neardup-groups")
    crowded = (F.col("root") == F.col("largest.root")) & (F.col("largest.n") > CROWD)
    placed = stored.join(groups.hint("merge"), "key")
    rest = placed.where(~crowded).select("key", "class", "v", "root")
    odd = F.bit_count(F.col("key").bitwiseAND(F.lit((1 << width) - 1))) % 2 == 1
    flips = [F.lit(1 << b).cast("long") for b in range(width)]
    ball = F.transform(F.when(odd, F.array(F.lit(0).cast("long"), *flips)).otherwise(F.array(F.lit(0).cast("long"))), lambda m: F.col("key").bitwiseXOR(m))
    asked = stored.select(F.col("class").alias("of"), F.col("root").alias("of_root"), F.col("v").alias("qv"), F.explode(ball).alias("key"))
    # Spark takes exploded tables for as small as before; neither is one to broadcast
    met = rest.join(asked.hint("merge"), "key").where("of_root <> root").where(near).select(*pair)
    # crowds that an odd segment of the rest is beside, and two crowds of neighbouring buckets: none has been looked up
    crowds = placed.where(crowded).select("key", "class", "v", "root")
    held = groups.where(F.col("largest.n") > CROWD).select("key", F.col("largest.root").alias("root"))
    beside = held.withColumn("other", F.explode(F.transform(F.array(*flips), lambda m: F.col("key").bitwiseXOR(m))))
    near_crowd = rest.where(odd).withColumnsRenamed({"key": "other", "class": "of", "v": "qv", "root": "of_root"}).join(beside.select("key", "other").hint("merge"), "other").select("key", "of", "of_root", "qv")
    late = crowds.join(near_crowd.hint("merge"), "key").where("of_root <> root").where(near).select(*pair)
    both = beside.where("key < other").join(held.select(F.col("key").alias("other"), F.col("root").alias("other_root")).hint("merge"), "other").where("root <> other_root").select("key", "other")
    one = crowds.join(both.hint("merge"), "key").select("other", F.col("class").alias("of"), F.col("v").alias("qv"))
    between = one.join(crowds.withColumnRenamed("key", "other").hint("merge"), "other").where(near).select(*pair)
    met = staged(met.unionByName(late).unionByName(between).groupBy("a", "b").agg(F.min("bits").alias("bits")), "neardup-met")
    # a text needs one link into a group: the closest of each group first, then whoever is still in different groups
    for _ in range(CLOSEST):
        of = lambda c: roots.select(F.col("class").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        apart = met.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
        best = F.min_by("there", F.struct("bits", "there")).alias("there")
        ways = [apart.select(F.col(x).alias("here"), F.col(y).alias("there"), F.col(f"{y}_root").alias("group"), "bits").groupBy("here", "group").agg(best) for x, y in ("ab", "ba")]
        pairs = staged(ways[0].unionByName(ways[1]).select(F.least("here", "there").alias("a"), F.greatest("here", "there").alias("b")).distinct(), "neardup-nearest")
        left = staged(met.join(pairs, ["a", "b"], "left_anti"), "neardup-met")  # no pair is looked at twice
        found = found.unionByName(staged(_verified(pairs, classes.join(roots, "class"), told, words, most, shingle, similarity), "neardup-closest"))
        linked = components(found, "neardup-closest").withColumnRenamed("node", "class")
        before, roots = roots, staged(classes.select("class").join(linked, "class", "left").select("class", F.coalesce("root", "class").alias("root")), "neardup-roots")
        dropped(before, met, pairs)
        met = left
    out = found.unionByName(staged(_verified(met.select("a", "b"), classes.join(roots, "class"), told, words, most, shingle, similarity), "neardup-rest"))
    dropped(met)
    dropped(groups, roots)
    return out


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the smallest doc_id, of equal ids the first by a hash of the row.

    Keeps all columns. Null ids count last; null texts are empty, and all texts without words are copies of each other, as
    are texts under `shingle` words with the same words; repeated rows leave one; an empty table gives an empty result.
    The choice is made on (doc_id, hash of the row) by an aggregation, so a large group is no task's.
    """
    small_batches(docs.sparkSession)
    names, (row,) = docs.columns, free_names(docs, "row")
    width, segments, words, most = plan(docs.count(), similarity, recall)
    keyed = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("h")))
    told = staged(described(keyed.select(f"{row}.none", f"{row}.id", f"{row}.h", F.col("text").alias("text")), shingle, words), "neardup-rows")
    p = [f"p{k}" for k in range(words)]
    same = {"w1": F.xxhash64("told", F.lit(1)), "w2": F.xxhash64(F.lit(2), "told")}
    classes = told.withColumns(same).groupBy("n", "w1", "w2", *p).agg(F.min(F.struct("none", "id", "h")).alias("least"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "neardup-classes")
    long = classes.where("n > 0")
    # of rows that are alike in all, one tells the words
    first = long.select("class", "least.*").join(told.select("none", F.col("id").alias("__id"), F.col("h").alias("__h"), "d", "told").dropDuplicates(["__h", "__id"]), (F.col("h") == F.col("__h")) & F.col("id").eqNullSafe(F.col("__id"))).select("class", "d", "told")
    first = staged(first, "neardup-told")
    known = long.select("class", *p).join(first.select("class", "d"), "class")
    linked = components(links(staged(known, "neardup-known"), first.select("class", "told"), width, segments, words, most, shingle, similarity), "neardup")
    best = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").groupBy(F.coalesce("root", "class")).agg(F.min("least").alias(row)).select(row)
    chosen = staged(best, "neardup-best")
    dropped(told, classes, first, linked)
    return keyed.join(chosen, row, "left_semi").dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in names])
