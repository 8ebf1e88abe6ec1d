"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order. Inverted lists hold, for each pivot, the
vectors that have it among their nearest. Two vectors are candidates if they share at least two of their `nearest`
pivots; candidates are verified by their cosine in double precision. A pair is looked at once: under the smallest pivot
that both have and the second smallest.

Pivots are a bounded sample (`pivots`, by default about 2 * sqrt(n), 256 at least, PIVOT_BYTES at most) of vectors that are
not close to each other, seen from the mean of the sample; every vector is indexed, in tables of any size. How many of them are used is measured:
pairs just at the threshold, made of the sample, and the linked pairs in it must share two pivots in `recall` of all cases,
or half as many pivots are tried. Where no number will do (all vectors in a narrow cone, where nearly all pairs are links),
the vectors of the length are compared as one list, so nothing is lost. Vectors of
each length are indexed by themselves.

A list of up to LONG blocks is compared as a whole; a longer one is cut by the second pivot first, so that lists grow slower
than the table. Lists are dealt into blocks, and pairs of blocks are the tasks, so a hot list is many tasks. A task returns
for each vector the number of its links, and a spanning forest of the links, never the pairs; so a crowd of near copies
costs products of matrices and no more. Equal vectors are one entry with a count.

For pairs at cosine 0.9, in 64 dimensions, two shared pivots of eight keep 0.99 or more; the tests measure recall
against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .components import components

PIVOT_BYTES = 64 << 20
#: Lengths of vectors that get pivots, the most frequent first; vectors of any other length are one list.
MOST_LENGTHS = 1024
#: Blocks of a list that is not cut further.
LONG = 4


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal sizes as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(unit: np.ndarray, most: int, cosine: float = 0.7) -> np.ndarray:
    """Places of the first vectors that are not close to one before: many pivots in one crowd would tell its members apart."""
    kept, places = np.zeros((0, unit.shape[1])), []
    for i in range(0, len(unit), 256):
        at = i + np.flatnonzero((unit[i : i + 256] @ kept.T < cosine).all(axis=1))
        close = np.tril(unit[at] @ unit[at].T >= cosine, -1)
        alone = np.ones(len(at), bool)
        for k in range(len(at)):
            alone[k] = not (close[k] & alone).any()
        kept = np.concatenate([kept, unit[at[alone]]])
        places += at[alone].tolist()
        if len(places) >= most:
            break
    return np.array(places[:most], np.int64)


def _nearest(unit: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest points of each vector, nearest first."""
    cosine = unit @ points.T
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, 1), axis=1, kind="stable"), 1)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots the vectors of two lists, row by row, have in common."""
    return (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)


def pivots_of(unit: np.ndarray, most: int, nearest: int, threshold: float, recall: float) -> np.ndarray:
    """Pivots from a sample of unit vectors: as many as keep `recall` of the pairs at the threshold; a single one if none do."""
    centred = unit - unit.mean(axis=0)
    size = np.sqrt((centred * centred).sum(axis=1, keepdims=True))
    points = unit[_apart(np.divide(centred, size, out=np.zeros_like(centred), where=size > 1e-9), most)]
    x = unit[:1024]
    toward = np.roll(unit, len(unit) // 2 + 1, axis=0)[:1024]
    side = toward - (toward * x).sum(axis=1, keepdims=True) * x
    long = np.sqrt((side * side).sum(axis=1, keepdims=True))
    apart = long[:, 0] > 1e-6
    made = x[apart], (threshold * x + max(0.0, 1 - threshold**2) ** 0.5 * np.divide(side, long, out=np.zeros_like(side), where=long > 1e-6))[apart]
    i, j = np.nonzero(np.triu(unit[:2048] @ unit[:2048].T >= threshold, 1))
    some = np.linspace(0, len(i) - 1, min(4096, len(i))).astype(np.int64)
    found = unit[i[some]], unit[j[some]]
    pairs = [p for p, least in ((made, 1), (found, 50)) if len(p[0]) >= least]
    count = len(points)
    while count > nearest:
        told = [(_shared(*(_nearest(side, points[:count], nearest) for side in p)) >= 2).mean() for p in pairs]
        if all(t >= recall for t in told):
            return points[:count]
        count //= 2
    return points[:1]


def _forest(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows and columns of a link matrix to edges (id, smallest id) of its components."""
    rows, cols = links.any(axis=1), links.any(axis=0)
    a, b, links = a[rows], b[cols], links[np.ix_(rows, cols)]
    if not len(a):
        return a, a
    label_a, label_b, top = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        label_a2 = np.minimum(label_a, np.where(links, label_b[None, :], top).min(axis=1))
        label_b2 = np.minimum(label_b, np.where(links, label_a2[:, None], top).min(axis=0))
        if (label_a2 == label_a).all() and (label_b2 == label_b).all():
            break
        label_a, label_b = label_a2, label_b2
    return np.concatenate([a, b]), np.concatenate([label_a, label_b])


def _verified(pivot: int, second: int, one: tuple, two: tuple | None, threshold: float):
    """Links of a block with itself (two is None) or with another: (ids, counts), (ids, roots). Second pivot: minus one for all."""
    (ids, many, unit, near) = one
    (ids2, many2, unit2, near2) = two or one
    counts, counts2, edges = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64), []
    for q in np.intersect1d(near, near2) if second < 0 else (second,):
        if q <= pivot and near.shape[1] > 1:  # vectors with one pivot have no second: the list is compared as a whole
            continue
        i = np.flatnonzero((near == q).any(axis=1))
        j = np.flatnonzero((near2 == q).any(axis=1)) if two else i
        if not len(i) or not len(j) or (two is None and len(i) < 2):
            continue
        links = unit[i] @ unit2[j].T >= threshold
        if two is None:
            np.fill_diagonal(links, False)
        # pairs that share a pivot below q, other than this list's, are looked at there
        hit, hit2 = links.any(axis=1), links.any(axis=0)
        if not hit.any():
            continue
        i, j, links = i[hit], j[hit2], links[np.ix_(hit, hit2)]
        lower = np.intersect1d(near[i], near2[j])
        lower = lower[(lower < q) & (lower != pivot)]
        if len(lower):
            has = lambda x: np.stack([(x == p).any(axis=1) for p in lower], axis=1).astype(np.float32)
            links &= ~(has(near[i]) @ has(near2[j]).T > 0)
        counts[i] += links @ many2[j]
        if two:
            counts2[j] += many[i] @ links
        edges.append(_forest(ids[i], ids2[j], links))
    if two:
        ids, counts = np.concatenate([ids, ids2]), np.concatenate([counts, counts2])
    found = counts > 0
    a, b = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
    own = a != b
    return (ids[found], counts[found]), (a[own], b[own])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, nearest: int = 8, pivots: int | None = None, block: int = 2048, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors`.

    n_links: other vectors with a cosine of at least `threshold`; component_id: smallest vec_id reachable. Null and zero
    vectors and those with null or non-finite components link with nothing and are their own component; vectors link with
    those of their own length. Null ids count last for component_id. Equal vectors on many rows link with each other.
    Repeated ids are rows of their own. An empty table gives an empty result; other columns are left out.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0).alias("v")).withColumn("ok", F.coalesce(~bad, F.lit(False)))
    rows = rows.withColumns({"k1": F.xxhash64("v", F.lit(1)), "k2": F.xxhash64(F.lit(2), "v")})  # equal vectors have equal keys of 128 bits
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("many")).withColumn("class", F.monotonically_increasing_id())
    classes = staged(classes, "vectors")
    # every length of more than one vector gets pivots, whatever the size; one job draws the samples of all lengths
    drawn = classes.select("v", F.size("v").alias("length"), F.xxhash64("k1", F.lit(11)).alias("draw"))
    sizes = [tuple(r) for r in drawn.groupBy("length").count().where("count > 1").orderBy(F.desc("count"), "length").limit(MOST_LENGTHS).collect()]
    many = {length: max(1, min(max(256, int(2 * n**0.5)) if pivots is None else pivots, PIVOT_BYTES // (8 * length * len(sizes)))) for length, n in sizes}
    points, first = {}, 0
    if many:
        wanted = vectors.sparkSession.createDataFrame([(length, 2 * many[length], min(1.0, (8 * many[length] + 64) / n)) for length, n in sizes], "length int, wanted int, share double")
        place = F.row_number().over(Window.partitionBy("length").orderBy("draw"))
        highest = 2 * max(many.values())
        some = drawn.join(F.broadcast(wanted), "length").where(F.pmod("draw", F.lit(1 << 31)) <= F.col("share") * (1 << 31))  # some four times as many as wanted
        taken = some.withColumn("place", place).where(F.col("place") <= highest).where("place <= wanted")
        taken = taken.select("length", "place", "v").toArrow().sort_by([("length", "ascending"), ("place", "ascending")])
        for length, most in sorted(many.items()):
            own = taken.filter(pc.equal(taken.column("length"), length)).column("v")
            points[length] = first, pivots_of(_unit(_rows(own)), most, nearest, threshold, recall)
            first += len(points[length][1])
    sent = vectors.sparkSession.sparkContext.broadcast(points)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pivots are numbered through; a length without pivots is one list, of minus its length."""
        for batch in batches:
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                own = batch if (lengths == length).all() else batch.take(pa.array(np.flatnonzero(lengths == length)))
                first, points = sent.value.get(length, (-length, np.zeros((1, length))))
                k = min(nearest, len(points))
                step = max(16, (1 << 22) // len(points))
                for part in (own.slice(i, step) for i in range(0, own.num_rows, step)):
                    near = np.zeros((part.num_rows, 1), np.int64) if len(points) == 1 else _nearest(_unit(_rows(part.column(2))), points, k)
                    order = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(near) + 1, k), pa.int32()), pa.array((near + first).ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), order], ["class", "many", "v", "near"])

    index = classes.select("class", "many", "v").mapInArrow(described, "class long, many long, v array<double>, near array<int>")
    index = staged(index, "vectors-index")
    lists = index.withColumn("pivot", F.explode(F.slice(F.sort_array("near"), 1, F.greatest(F.size("near") - 1, F.lit(1)))))
    sizes = staged(lists.groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "vectors-lists")
    whole = (F.col("blocks") <= LONG) | (F.size("near") == 1)
    listed = lists.join(sizes, "pivot")  # one row for each pivot
    short = listed.where(whole).withColumn("second", F.lit(-1))
    cut = listed.where(~whole).drop("blocks").withColumn("second", F.explode(F.filter("near", lambda q: q > F.col("pivot"))))
    cut_sizes = cut.groupBy("pivot", "second").count().where("count > 1").select("pivot", "second", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    deep = cut.join(staged(cut_sizes, "vectors-lists-2"), ["pivot", "second"])
    dealt = (
        short.unionByName(deep)
        .withColumn("own", F.pmod(F.xxhash64("class", "pivot", "second"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("pivot", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "many", F.col("v").cast("array<float>").alias("v") if dict(vectors.dtypes)[vector_col] == "array<float>" else "v", "near")
    )

    def verified(key: tuple, table: pa.Table) -> pa.Table:
        pivot, second, i, j = (k.as_py() for k in key)
        own, ids, many = (table.column(c).to_numpy() for c in ("own", "class", "many"))
        unit, near = _unit(_rows(table.column("v"))), _rows(table.column("near"))
        part = lambda x: (ids[x], many[x], unit[x], near[x])
        (a, n), (b, root) = _verified(pivot, second, part(own == i), None if i == j else part(own == j), threshold)
        empty = np.zeros(len(b), np.int64)
        return pa.table({"class": np.concatenate([a, b]), "root": np.concatenate([np.full(len(a), -1), root]), "n": np.concatenate([n, empty])})

    found = staged(dealt.groupBy("pivot", "second", "i", "j").applyInArrow(verified, "class long, root long, n long"), "vectors-links")
    counts = found.where("root < 0").groupBy("class").agg(F.sum("n").alias("n"))
    linked = components(found.where("root >= 0").select(F.col("class").alias("a"), F.col("root").alias("b")), "vectors")
    known = classes.drop("v").join(counts, "class", "left").join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component")), "root").select("k1", "k2", "component", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("links"))
    out = rows.drop("v").join(known.withColumn("ok", F.lit(True)), ["ok", "k1", "k2"], "left")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
