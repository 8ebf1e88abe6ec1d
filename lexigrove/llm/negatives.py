"""Hard negatives by inner product, through a table of distances to pivots.

Vectors are quantised to integers and augmented by one coordinate that brings all of them to the length of the longest; an
anchor gets a zero there. The distance of an anchor to a vector is then d^2 = |anchor|^2 + longest^2 - 2 * inner product, so the
largest inner product is the smallest distance, and distances obey the triangle inequality. The index holds each vector with
its distances to a few pivots. From these and the anchor's own a score is bracketed: for a block of vectors at first, by the
ranges of its pivot distances, then for single vectors; what may belong to a result is checked exactly, in integers. Vectors
of one label and one nearest pivot lie together, so that blocks are narrow.

Anchors are taken in waves of a bounded number. A wave is sent to all tasks, and each reads its share of the index once for
the positives and once for the negatives, keeping the best few of each anchor; so no pair leaves a task that does not stand
among the best of its share, and no task holds more than a wave and a block. A lost executor costs its shares of the wave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged

#: Vectors that the pivots are chosen from, and rows of a block whose scores are bracketed together.
SAMPLE, BLOCK_ROWS = 1024, 512
#: Anchors that are held against a block at a time.
STEP = 1024
NONE = np.iinfo(np.int64).max


def quantised(vectors: pa.Array | pa.ChunkedArray, factor: float) -> np.ndarray:
    """floor(factor * x) of list columns of one length, as whole numbers in doubles."""
    a = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.floor(factor * a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1))


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes their squared length `longest`."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b; b has few."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1) if len(b) else np.zeros((len(a), 0))


def pivots_of(x: np.ndarray, longest: float, count: int) -> np.ndarray:
    """Augmented vectors of a sample, each the farthest from those chosen before."""
    points = augmented(x, longest)
    if not len(points):
        return points
    chosen, far = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class Anchors:
    """A wave's anchors of one vector length: integer vectors, labels, rows of origin, distances to the pivots."""

    def __init__(self, x: np.ndarray, label: np.ndarray, row: np.ndarray, d: np.ndarray, longest: float):
        self.x, self.label, self.row, self.d, self.longest = x, label, row, d, longest
        self.own = (x * x).sum(axis=1)
        self.slack = 1e-9 * (self.own + longest) + 1e-6  # of rounding in distances

    def brackets(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of anchors `at` with vectors whose pivot distances lie between low and high (rows, pivots)."""
        whole = self.own[at] + self.longest
        gap, reach = np.zeros((len(at), len(low))), np.full((len(at), len(low)), np.inf)
        for k in range(self.d.shape[1]):
            d = self.d[at, k, None]
            np.maximum(gap, np.maximum(low[None, :, k] - d, d - high[None, :, k]), out=gap)
            np.minimum(reach, d + high[None, :, k], out=reach)
        slack = self.slack[at, None]
        return (whole[:, None] - reach * reach) / 2 - slack, (whole[:, None] - gap * gap) / 2 + slack


class Best:
    """The best `k` rows of each of n slots: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id, self.row = np.full((n, k), NONE), np.full((n, k), NONE)

    def least(self, slots: np.ndarray) -> np.ndarray:
        """The score that a further row must have at least."""
        return self.score[slots, -1]

    def add(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """score (slots, rows), -inf where a row does not count."""
        if score.shape[1] > self.k:
            bar = np.partition(score, -self.k, axis=1)[:, -self.k]
            hits = score >= np.maximum(bar, self.least(slots))[:, None]
        else:
            hits = score >= self.least(slots)[:, None]
        i, j = np.nonzero(hits & (score > -np.inf))
        if not len(i):
            return
        touched, i = np.unique(i, return_inverse=True)
        at = slots[touched]
        slot = np.concatenate([i, np.repeat(np.arange(len(at)), self.k)])
        value = np.concatenate([score[touched[i], j], self.score[at].ravel()])
        name, row = np.concatenate([ids[j], self.id[at].ravel()]), np.concatenate([rows[j], self.row[at].ravel()])
        order = np.lexsort((row, name, -value, slot))
        slot = slot[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order, slot, nth = order[nth < self.k], slot[nth < self.k], nth[nth < self.k]
        for held, new in ((self.score, value), (self.id, name), (self.row, row)):
            held[at[slot], nth] = new[order]


def _exact(x: np.ndarray, rows: np.ndarray, able: np.ndarray) -> np.ndarray:
    """Inner products where `able`, -inf elsewhere; whole numbers below 2^53, so doubles are exact."""
    if able.mean() > 0.05:
        return np.where(able, x @ rows.T, -np.inf)
    out = np.full(able.shape, -np.inf)
    i, j = np.nonzero(able)
    out[i, j] = np.einsum("ij,ij->i", x[i], rows[j])
    return out


def positives_of(a: Anchors, best: Best, x: np.ndarray, d: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Rows of a block with the anchors' own labels, other than the anchors themselves, into `best`."""
    for own in np.unique(label):
        at, here = np.flatnonzero(a.label == own), np.flatnonzero(label == own)
        for i in range(0, len(at), STEP):
            part = at[i : i + STEP]
            _, most = a.brackets(part, d[here].min(axis=0)[None], d[here].max(axis=0)[None])
            part = part[most[:, 0] >= best.least(part)]
            if not len(part):
                continue
            _, most = a.brackets(part, d[here], d[here])
            able = (most >= best.least(part)[:, None]) & (a.row[part, None] != rows[None, here])
            if able.any():
                best.add(part, _exact(a.x[part], x[here], able), ids[here], rows[here])


def negatives_of(a: Anchors, low: np.ndarray, high: np.ndarray, best: Best, x: np.ndarray, d: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Rows of a block with other labels whose score lies in a window (anchors, windows) into `best`, a slot for each window."""
    windows = low.shape[1]
    bottom, top = d.min(axis=0)[None], d.max(axis=0)[None]
    alone = label[0] if (label == label[0]).all() else None
    for i in range(0, len(a.x), STEP):
        part = np.arange(i, min(i + STEP, len(a.x)))
        if alone is not None:
            part = part[a.label[part] != alone]
        slots = part[:, None] * windows + np.arange(windows)
        need = np.maximum(low[part], best.least(slots.ravel()).reshape(slots.shape))
        least, most = a.brackets(part, bottom, top)
        some = ((need <= high[part]) & (most >= need) & (least <= high[part])).any(axis=1)
        part, slots, need = part[some], slots[some], need[some]
        if not len(part):
            continue
        least, most = a.brackets(part, d, d)
        floor = np.where(need <= high[part], need, np.inf).min(axis=1)[:, None]
        able = (most >= floor) & (least <= high[part].max(axis=1)[:, None]) & (a.label[part, None] != label[None])
        if not able.any():
            continue
        score = _exact(a.x[part], x, able)
        for w in range(windows):
            own = np.flatnonzero(need[:, w] <= high[part, w])
            if len(own):
                inside = (score[own] >= low[part[own], w, None]) & (score[own] <= high[part[own], w, None])
                best.add(slots[own, w], np.where(inside, score[own], -np.inf), ids, rows)


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, factor: float = 256.0, pivots: int = 16, wave: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` is a condition on the columns of `vectors`. Components x become floor(factor * x); scores are inner products
    of these. An anchor's positives are its best `positives` other rows of its label. For each, negatives are the best
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score; larger scores come
    first, then smaller ids. Labels are whole numbers. Rows without id, label or vector and those with null or non-finite
    components or none at all take no part; a vector meets those of its own length; repeated ids are rows of their own, and
    a row is never its own positive; other columns play no part; an empty table gives an empty result. Scores that a double
    does not hold exactly (squared lengths of 2^53 and more after scaling) are an error.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    good = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & (F.size("v") > 0)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = staged(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & good).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * factor).cast("double"), F.lit(2.0)))
    longest = rows.agg(F.max(square)).first()[0] or 0.0
    if longest >= 2**53:
        raise ValueError("the vectors are too long for exact scores")
    taken = rows.orderBy(F.xxhash64("row", F.lit(3))).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    lengths = pc.list_value_length(taken).to_numpy(zero_copy_only=False)
    points = {int(n): pivots_of(quantised(taken.filter(pa.array(lengths == n)), factor), longest, pivots) for n in np.unique(lengths)}
    sent = spark.sparkContext.broadcast(points)

    def of_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.RecordBatch | pa.Table]]:
        n = pc.list_value_length(batch.column("v"))
        n = np.asarray(n.to_numpy(zero_copy_only=False) if isinstance(n, pa.Array) else n.to_numpy())
        for length in np.unique(n).tolist():
            yield length, batch if (n == length).all() else batch.filter(pa.array(n == length))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in of_length(batch):
                points = sent.value.get(length, np.zeros((0, length + 1)))  # a length outside the sample has no pivots and is checked exactly
                d = distances(augmented(quantised(part.column("v"), factor), longest), points)
                cell = d.argmin(axis=1) if d.shape[1] else np.zeros(len(d), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("id", "v", "label", "anchor", "row")] + [lists, pa.array(cell)], ["id", "v", "label", "anchor", "row", "d", "cell"])

    index = rows.mapInArrow(described, f"id long, v {kind}, label long, anchor boolean, row long, d array<double>, cell long")
    index = staged(index.repartitionByRange("label", "cell", "row").sortWithinPartitions("label", "cell", "row"), "negatives-index")
    dropped(rows)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for length, part in of_length(batch):
                x = quantised(part.column("v"), factor)
                d = part.column("d").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                label, ids, row = (part.column(c).to_numpy() for c in ("label", "id", "row"))
                for i in range(0, len(x), BLOCK_ROWS):
                    s = slice(i, i + BLOCK_ROWS)
                    yield length, (x[s], d[s], label[s], ids[s], row[s])

    def told(best: Best, key: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(best.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i], extra[i], best.score[i, j].astype(np.int64), best.id[i, j], best.row[i, j])], ["anchor", "positive_score", "score", "id", "row"])

    schema = "anchor long, positive_score long, score long, id long, row long"
    ranked = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "id", "row")
    n_anchors = index.where("anchor").count()
    waves = -(-n_anchors // wave)
    held, found = [], []
    for w in range(waves):
        own = index.where("anchor").where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(waves)) == w).select("v", "label", "row").toArrow()
        group = {}
        for length, part in of_length(own):
            x = quantised(part.column("v"), factor)
            d = distances(np.column_stack([x, np.zeros(len(x))]), points.get(length, np.zeros((0, length + 1))))  # an anchor's further coordinate is zero
            group[length] = Anchors(x, part.column("label").to_numpy(), part.column("row").to_numpy(), d, longest)
        anchors = spark.sparkContext.broadcast(group)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {n: Best(len(a.x), positives) for n, a in anchors.value.items()}
            for length, block in blocks(batches):
                if length in best:
                    positives_of(anchors.value[length], best[length], *block)
            for n, a in anchors.value.items():
                yield told(best[n], a.row, np.zeros(len(a.x), np.int64))

        best = index.select("id", "v", "label", "row", "d").mapInArrow(near, schema)
        best = staged(best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives).select("anchor", "score", "id", "rank"), "negatives-positives")
        # `positives` numbers an anchor of the wave
        scores = best.select("anchor", "score", "rank").toArrow()
        windows = {}
        for n, a in group.items():
            low_of, high_of, score_of = np.full((len(a.x), positives), np.inf), np.full((len(a.x), positives), -np.inf), np.zeros((len(a.x), positives), np.int64)
            order = np.argsort(a.row)
            at = np.minimum(np.searchsorted(a.row[order], scores.column("anchor").to_numpy()), len(order) - 1)
            mine_ = a.row[order][at] == scores.column("anchor").to_numpy()
            i, k, s = order[at][mine_], scores.column("rank").to_numpy()[mine_] - 1, scores.column("score").to_numpy()[mine_]
            low_of[i, k], high_of[i, k], score_of[i, k] = -((-low * s) // 100), (high * s) // 100, s
            again = np.zeros_like(low_of, bool)
            again[:, 1:] = (score_of[:, 1:] == score_of[:, :-1]) & (high_of[:, :-1] > -np.inf)  # equal scores share a window
            low_of[again], high_of[again] = np.inf, -np.inf
            windows[n] = low_of, high_of, score_of
        asked = spark.sparkContext.broadcast(windows)

        def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {n: Best(len(a.x) * positives, negatives) for n, a in anchors.value.items()}
            for length, block in blocks(batches):
                if length in best:
                    negatives_of(anchors.value[length], *asked.value[length][:2], best[length], *block)
            for n, a in anchors.value.items():
                yield told(best[n], np.repeat(a.row, positives), asked.value[n][2].ravel())

        worst = index.select("id", "v", "label", "row", "d").mapInArrow(hard, schema)
        worst = worst.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
        names = index.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        pairs = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(worst.select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"]).join(names, "anchor")
        found.append(staged(pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))
        held.append(best)
        anchors.unpersist()
        asked.unpersist()
    dropped(index, *held)
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(found[0].schema).parquet(*[f.staged_path for f in found])
