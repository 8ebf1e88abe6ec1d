"""Token ids in bit and byte planes: the encoder against the tokenizer, files against a plain count, odd rows."""

import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexigrove.llm import planes
from lexigrove.llm.queries import QUERIES

from .test_operators import ODD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    None, "", " ", "\n\n", "a", "don't stop'st it's 'til", "é, è à la", "a  b \n c\n\nd", "x<|endoftext|>y, z", "12.5 3,000", "中文 字 。", "a　b  c, d　 e",
    "\x00 a\x1c b\x85 c \x85 d", "  lead", "trail  ", "a,b;c", "word\t next", "  x", "ab̀ c",
]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected(rows):
    """(doc_id, start, n_tokens, crc) in the order of the files; equal ids in any order are the caller's care."""
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), digest(ids)))
        at += len(ids)
    return out


def test_encoder_is_the_tokenizer(spark, sf):
    tokenizer, encoder = Tokenizer.from_file(PATH), planes.ByteEncoder(PATH)
    r = random.Random(3)
    signs = list(" \n\t,.'abcXYZéàß×÷12 　\u0085\xa0中́😀<|>") + ["'s", "'re", " the", "<|endoftext|>"]
    texts = HARD + ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)] + [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for part in (texts, texts[7:900]):  # a second time with known pieces, from a slice of a longer column
        ids, bounds = encoder.encode(pa.array(texts, pa.string()).slice(texts.index(part[0]), len(part)))
        for i, text in enumerate(part):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(planes, "REMEMBERED", 3)
    encoder = planes.ByteEncoder(PATH)
    for text in ("one two three four five", "six one", "two seven"):
        assert encoder.encode(pa.array([text]))[0].tolist() == ids_of(text)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    r = np.random.default_rng(1)
    for ids in ([], [0], [0, 0, 0], [65535], [1, 2, 3], r.integers(0, 1 << 16, 1000), r.integers(0, 1 << 31, 77), r.integers(0, 300, 8)):
        ids = np.array(ids, np.uint32)
        made = planes.to_planes(ids, kind)
        assert len(made) == (int(ids.max()).bit_length() if kind == "bit" else -(-int(ids.max()).bit_length() // 8)) if len(ids) else not made
        assert planes.from_planes(made, len(ids), kind).tolist() == ids.tolist()


@pytest.mark.parametrize(("kind", "block"), [("bit", 64), ("byte", 1000), ("byte", 1 << 16)])
def test_files(spark, sf, kind, block):
    """Documents longer than blocks, blocks with many documents, and stretches of ids."""
    path = f"{tempfile.mkdtemp(prefix='spark-')}/ids"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    planes.write(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), path, PATH, block=block, kind=kind)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in planes.documents(spark, path).collect())
    assert got == expected(rows)
    total = got[-1][1] + got[-1][2]
    index = sorted(planes.index(spark, path).collect(), key=lambda r: r.first)
    assert [r.first for r in index] == [0, *np.cumsum([r.n for r in index]).tolist()[:-1]] and sum(r.n for r in index) == total
    assert all(r.n <= block for r in index)
    every = np.concatenate([np.array([*ids_of(t), 2]) for _, t in rows[:40]])
    for first, end in ((0, 5), (3, 3 + 2 * block), (1234, 2345), (total - 1, total + 99), (total, total + 5), (7, 7)):
        pieces = sorted(planes.read(spark, path, first, end).collect(), key=lambda r: r.start + r.at)
        held = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(r.ids, "<u4") for r in pieces]])
        assert len(held) == max(0, min(end, total) - first)
        if end <= len(every):
            assert held.tolist() == every[first:end].tolist()
        at = first
        for r in pieces:
            assert r.start + r.at == at
            at += len(r.ids) // 4


def test_a_damaged_block_is_an_error(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/ids"
    planes.write(docs(spark, [(1, "some words", "en", "a")]), path, PATH)
    block = spark.read.parquet(f"{path}/blocks").collect()[0]
    block = block.asDict(recursive=True) | {"planes": planes.to_planes(np.arange(block.n, dtype=np.uint32), block.kind)}
    spark.createDataFrame([block], planes.BLOCK).write.mode("overwrite").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="damaged"):
        planes.documents(spark, path).collect()


def test_odd(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/ids"
    rows = [*ODD, (9, "<|endoftext|> x", "en", "a")]
    planes.write(docs(spark, rows), path, PATH)
    got = sorted(planes.documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((r.doc_id or -1, r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted((d or -1, n, c) for d, _, n, c in expected([(r[0], r[1]) for r in rows]))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    path = f"{tempfile.mkdtemp(prefix='spark-')}/ids"
    planes.write(docs(spark, rows).where("false"), path, PATH)
    assert planes.documents(spark, path).count() == 0 and planes.read(spark, path, 0, 5).count() == 0


def test_query(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in QUERIES["op11_token_planes"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected(rows)
