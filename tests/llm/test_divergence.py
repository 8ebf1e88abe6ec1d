"""The divergence of sources against plain Python over all terms of all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lexigrove.llm import divergence

from .test_operators import ODD, docs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs=10, top=10):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            above = [(t, f(own[s][t], q[t])) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", above)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items) if part == "pair" or r < top}
    return out


def told(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("bucket", [5, 1 << 14])
def test_against_all_terms(spark, bucket, monkeypatch):
    """A language without kept terms, sources that share none, one source alone, ties, many buckets and slices."""
    monkeypatch.setattr(divergence, "SLICE", 300)
    r = random.Random(bucket)
    words = ["Ähre", "zoo", "Zoo", "é", "𝄞x", "don't", "a1b", "中文", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(i, " ".join(r.choices(words, range(1, len(words) + 1), k=r.randrange(0, 40))), r.choice(["en", "en", "de"]), r.choice(["a", "b", "ü", None])) for i in range(200)]
    rows += [(300 + i, "rare words here", "fr", "a") for i in range(4)] + [(310, None, "fr", "b"), (311, "", "en", "empty"), (312, "q" * 70000, "en", "long")]
    rows += [(400 + i, "alone " * 3, "it", "one") for i in range(12)] + [(500 + i, "x y", "nl", "p") for i in range(10)] + [(520 + i, "z", "nl", "q") for i in range(10)]
    assert told(divergence.audit(docs(spark, rows).repartition(3), bucket=bucket)) == brute(rows)


def test_terms():
    import pyarrow as pa

    texts = ["", "a", "Ab-CD", "x y", "1", " a", "b ", "é1é", "", "tail"]
    found, doc = divergence.terms(pa.array(["skipped", *texts]).slice(1))
    assert list(zip(doc.tolist(), found.to_pylist())) == [(i, t) for i, x in enumerate(texts) for t in TERM.findall(x.translate(LOWER))]


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 10**13 + 7, 3 * 10**13 + 1, 10**9
    p = divergence.share(F.lit(n), F.lit(total), F.lit(kept).cast("long"))
    got = spark.range(1).select(p.alias("p"), divergence.apart(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert got.p == 1 + 10**9 * (n + 2) // (total + 2 * kept) and got.f == (10**9) ** 2 // (10**9 + 2)


def test_odd(spark):
    rows = ODD * 5
    assert told(divergence.audit(docs(spark, rows))) == brute(rows)
    assert divergence.audit(docs(spark, rows).where("false")).count() == 0
