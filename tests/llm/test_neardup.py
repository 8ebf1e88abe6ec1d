"""Near-duplicates by verified similarity, against brute force over all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from lexigrove.llm import neardup

from .test_operators import ODD, brute_components, docs


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or tuple(w)


def similar(x, y):
    if isinstance(x, tuple) or isinstance(y, tuple):
        return x == y
    return len(x & y) >= 0.8 * len(x | y)


def brute_kept(rows):
    """The smallest id of each group, of all rows (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    return sorted(set(brute_components(sorted(sets), lambda a, b: similar(sets[a], sets[b])).values()))


def copies(seed, groups=40, sizes=(1, 2, 5), edits=4):
    """Texts and near copies of them, each with some words changed."""
    rng = np.random.default_rng(seed)
    vocabulary, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(groups):
        base = rng.choice(vocabulary, int(rng.integers(30, 160))).tolist()
        for _ in range(int(rng.choice(sizes))):
            text = base.copy()
            for at in rng.integers(0, len(text), int(rng.integers(0, edits + 1))):
                text[at] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = copies(seed)
    got = neardup.deduplicated(docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_on_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = neardup.deduplicated(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in got) == brute_kept(rows)


@pytest.mark.parametrize("stars", [1, 3])
def test_crowds(spark, monkeypatch, stars):
    """Buckets that all share: by stars, and who they leave out in groups of any size."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup, "plan", lambda n, similarity, recall: (8, 8, 1, 21))
    rows = copies(7, groups=12, sizes=(30, 60), edits=3)
    rows += [(len(rows) + i, t) for i, t in enumerate(dict.fromkeys(t for _, t in copies(8, groups=200, sizes=(1,))))]
    kept = sorted(r.doc_id for r in neardup.deduplicated(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect())
    want = brute_kept(rows)
    assert set(want) <= set(kept) and len(kept) <= len(want) + 1  # none too few; a link may be missed


def test_crowds_miss_no_candidate(spark, monkeypatch):
    """Groups are those of all similar pairs that share a ball, though crowds fill the buckets and stars join little."""
    width, segments, words, most = 8, 2, 1, 24
    monkeypatch.setattr(neardup, "CROWD", 2)
    monkeypatch.setattr(neardup, "STARS", 1)
    monkeypatch.setattr(neardup, "plan", lambda n, similarity, recall: (width, segments, words, most))
    rows = list({t: (i, t) for i, t in copies(11, groups=12, sizes=(20, 30), edits=6)}.values())
    found, bounds = neardup._word_hashes(pa.array([t for _, t in rows]))
    hashes = [np.unique(neardup._shingles(found[s:e], 5)) for s, e in zip(bounds[:-1], bounds[1:])]
    bits = {i: np.unpackbits(np.array(neardup.prints(h, words), np.int64).view(np.uint8), bitorder="little") for (i, _), h in zip(rows, hashes)}
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        differ = bits[a] ^ bits[b]
        near = differ.sum() <= most and min(differ[k * width : (k + 1) * width].sum() for k in range(segments)) <= 1
        return near and similar(sets[a], sets[b])

    want = sorted(set(brute_components(sorted(sets), linked).values()))
    got = neardup.deduplicated(docs(spark, [(i, t, "en", "s") for i, t in rows]))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_crowds_of_neighbouring_buckets(spark, monkeypatch):
    """Two crowds that only a flipped bit brings together, each the largest group of its bucket, are linked."""
    monkeypatch.setattr(neardup, "CROWD", 2)
    told = np.arange(40, dtype="<u2").tobytes()
    prints = {0: 0x0F00, 1: 0xF001}  # one bit apart in the first segment, all in the second
    classes = spark.createDataFrame([(i, 37, prints[i % 2]) for i in range(12)], "class long, d long, p0 long")
    found = neardup.links(classes, spark.createDataFrame([(i, told) for i in range(12)], "class long, told binary"), 8, 2, 1, 64, 5, 0.8)
    assert {r.root for r in neardup.components(found).collect()} == {0}


def test_odd(spark):
    df = docs(spark, [*ODD, (8, "THE\tcat  sat", "en", "z"), (9, "the cat", "en", "z"), (10, "the word of " * 19000, "en", "b")])
    got = neardup.deduplicated(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 6, 7, 9]
    assert neardup.deduplicated(docs(spark, [(None, "a", "en", "s"), (None, "a", "en", "s")])).count() == 1
    assert neardup.deduplicated(df.where("false")).count() == 0
    one = neardup.deduplicated(docs(spark, [(3, "a b c d e f", "en", "s"), (3, "a b c d e f", "en", "s"), (3, "x y z u v w", "en", "s")]))
    assert sorted(r.text for r in one.collect()) == ["a b c d e f", "x y z u v w"]


def test_plan_keeps_its_recall():
    """The share of pairs at the threshold that meet in some bucket, by trial, for tables of several sizes."""
    rng = np.random.default_rng(5)
    for n in (100, 10**5, 10**8):
        width, segments, words, most = neardup.plan(n, 0.8)
        assert width <= 30 and width * segments <= 64 * words
        met = 0
        for _ in range(300):
            both = rng.integers(0, 1 << 63, 800).astype(np.uint64)
            own = rng.integers(0, 1 << 63, (2, 100)).astype(np.uint64)  # 800 of 1,000 in common
            a, b = (np.array(neardup.prints(np.concatenate([both, x]), words), np.int64).view(np.uint8) for x in own)
            bits = np.unpackbits(a ^ b, bitorder="little")
            met += bits.sum() <= most and min(bits[i * width : (i + 1) * width].sum() for i in range(segments)) <= 1
        assert met / 300 >= 0.9, (n, met / 300)
