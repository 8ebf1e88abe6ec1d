"""Token ids in files of bit planes.

Documents are dealt into ranges of ascending doc_id, encoded there, and their ids, each document closed by an end id, form one
row of ids. It is cut into blocks of `block` ids. A block is transposed: plane k holds byte (or bit) k of all its ids, and
planes above the largest id are left out. The high planes of frequent ids repeat, so each plane by itself is compressed by
zstandard better than ids are: on the documents to 0.64 of two bytes an id by bytes, 0.75 by bits. The files are Parquet with one row a block: its planes, and the documents
that lie in it, in whole or in part. Beside them lie an index of the blocks, with the place of each in the row of all ids,
and the places of the ranges; a reader of a stretch of ids looks blocks up in the index and reads no others.

Spark's committer writes the files, so a lost executor or a task run twice leaves no half of one.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, small_batches
from .packing import SLICE, Encoder, Merges

BLOCK = "part int, block int, first long, n int, kind string, planes array<binary>, crc long, docs array<struct<doc_id: long, start: long, n: long>>"
INDEX = "part int, block int, first long, n int, bytes long"
#: Pieces whose ids a Python worker remembers.
REMEMBERED = 500_000
PARTS = "part int, base long, ids long"
#: Pieces that the merges can encode, each a single word of the vocabulary's own splitting: letters of Latin-1, digits or marks, after one space or none.
PLAIN = "^ ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[.,;:!?]+)$"


def _classes() -> np.ndarray:
    """By byte: 1 a space or line feed, 2 an ASCII letter, 3 another printable but the apostrophe, 4 the apostrophe or a digit, 5 not ASCII, 0 a control."""
    found = np.zeros(256, np.uint8)
    found[0x21:0x7F] = 3
    for first, last in ("AZ", "az"):
        found[ord(first) : ord(last) + 1] = 2
    found[ord("0") : ord("9") + 1] = 4
    found[ord("'")] = 4
    found[[ord(" "), ord("\n")]] = 1
    found[0x80:] = 5
    return found


CLASSES = _classes()


class ByteEncoder(Encoder):
    """Token ids of whole columns of texts for a byte-level vocabulary, those of `Tokenizer.encode`.

    The vocabulary splits texts into runs of letters, digits, marks and white space, the last space of a run going with what
    follows. So a text can be cut before a run of white space and between a letter and a mark, and the ids of the pieces one
    after the other are the text's. Each distinct piece is encoded once. Texts with a special token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in two bytes each; the vocabulary has more")
        if said["normalizer"] or said["pre_tokenizer"].get("type") != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("the vocabulary is not byte-level, or changes its texts")
        self.special = [t["content"] for t in said["added_tokens"]]
        self.merges = Merges(said["model"] | {"end_of_word_suffix": ""})
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def learn(self, words: pa.Array) -> np.ndarray:
        """The ids of new pieces, words by the merges, all others by the tokenizer; returns the places of `words` among all known."""
        plain = pc.match_substring_regex(words, PLAIN)
        simple, other = words.filter(plain), words.filter(pc.invert(plain))
        ids, sizes = self.merges.encode(simple)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(other.to_pylist(), add_special_tokens=False)]
        ids = np.concatenate([ids, np.array([i for own in found for i in own], np.int64)]).astype(np.uint16)
        sizes = np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))])
        self.words = pa.concat_arrays([self.words, simple, other])
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])
        first = plain.to_numpy(zero_copy_only=False)
        return len(self.words) - len(words) + np.where(first, np.cumsum(first) - 1, len(simple) + np.cumsum(~first) - 1)

    @staticmethod
    def pieces(texts: pa.StringArray, whole: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """(pieces of all texts, how many pieces end at each text's end); texts marked in `whole` are not cut."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        octets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind = CLASSES[octets]
        cut = np.zeros(len(octets) + 1, bool)
        if len(octets) > 2:
            now, before, last, ahead = kind[2:], kind[1:-1], octets[1:-1], octets[:-2]
            latin = (ahead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
            # white space beyond ASCII ends in C2 xx, or in xx 80 .., xx 81 .., xx 9A ..: what may be such is not cut after
            dark = (before >= 2) & ((before < 5) | ~((ahead == 0xC2) | (ahead == 0x80) | (ahead == 0x81) | (ahead == 0x9A)))
            cut[2:-1] = ((now == 1) & dark) | ((now == 3) & ((before == 2) | latin))
            for i in np.flatnonzero(whole):
                cut[bounds[i] : bounds[i + 1]] = False
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        if not len(octets):
            return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
        found = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(octets))
        return found, np.searchsorted(starts, bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]; null is empty."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        found, offsets = self.pieces(texts, whole)
        if not len(found):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        coded = found.dictionary_encode()
        distinct = coded.dictionary
        if len(self.words) > REMEMBERED:
            self.forget()
        places = pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = places < 0
        if new.any():
            places[new] = self.learn(distinct.filter(pa.array(new)))
        words = places[coded.indices.to_numpy(zero_copy_only=False)]
        ids, ends = self._gather(words)
        return ids, np.concatenate([[0], ends])[offsets]


_encoders: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, kind: str = "bit", level: int = 3) -> list[bytes]:
    """The planes of a block of ids, lowest first, each compressed; planes above the largest id are left out."""
    deep = int(ids.max()).bit_length() if len(ids) else 0
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-deep // 8)]
    if kind == "byte":
        return [squeeze(row.tobytes()) for row in octets]
    return [squeeze(np.packbits((octets[k // 8] >> (k % 8)) & 1, bitorder="little").tobytes()) for k in range(deep)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The ids of a block as unsigned 32-bit numbers."""
    ids = np.zeros(n, "<u4")
    opened = zstandard.ZstdDecompressor().decompress
    if kind == "byte":
        for k, plane in enumerate(planes):
            ids |= np.frombuffer(opened(plane), np.uint8).astype("<u4") << np.uint32(8 * k)
        return ids
    octets = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        octets[k // 8] |= np.unpackbits(np.frombuffer(opened(plane), np.uint8), count=n, bitorder="little") << np.uint8(k % 8)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


class _Blocks:
    """Cuts a range's row of ids into blocks; holds less than a block and one slice of texts."""

    def __init__(self, part: int, block: int, kind: str, level: int):
        self.part, self.size, self.kind, self.level = part, block, kind, level
        self.held, self.first, self.number = np.zeros(0, np.uint16), 0, 0
        self.docs: list[tuple] = []  # (doc_id, start, n), those that reach into what is held

    def add(self, ids: np.ndarray, doc_ids: list, sizes: np.ndarray) -> None:
        starts = self.first + len(self.held) + np.cumsum(sizes) - sizes
        self.docs += zip(doc_ids, starts.tolist(), sizes.tolist())
        self.held = np.concatenate([self.held, ids])

    def take(self, all_of_it: bool = False) -> pa.RecordBatch | None:
        """Whole blocks, and at the end the rest; None where there is none."""
        out, at, seen = [], 0, 0
        while len(self.held) - at >= self.size or (all_of_it and at < len(self.held)):
            ids = self.held[at : at + self.size]
            first, end = self.first + at, self.first + at + len(ids)
            last = seen
            while last < len(self.docs) and self.docs[last][1] < end:
                last += 1
            own = [{"doc_id": d, "start": s, "n": n} for d, s, n in self.docs[seen:last]]
            planes = to_planes(ids, self.kind, self.level)
            out.append((self.part, self.number, first, len(ids), self.kind, planes, zlib.crc32(ids.astype("<u4").tobytes()), own))
            seen = last - 1 if self.docs[last - 1][1] + self.docs[last - 1][2] > end else last
            at += len(ids)
            self.number += 1
        if not out:
            return None
        self.held, self.first, self.docs = self.held[at:].copy(), self.first + at, self.docs[seen:]
        docs = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.int64(), docs)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["part", "block", "first", "n", "kind", "planes", "crc", "docs"])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = 1 << 16, kind: str = "byte", level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The token ids of all documents as files under `path`, which must not exist.

    Ids are in ascending order of doc_id, null ids first, and each document ends with `end_id`. Null texts are empty and have
    the end id alone; repeated rows are written each, and rows of one id in the order of a hash of their texts, so one id on
    very many rows is dealt to many ranges. Other columns are left out. An empty table gives files without blocks.
    `kind` is bit or byte; `path` holds the folders blocks, index (part, block, first, n, bytes) and parts (part, base, ids).
    """
    if kind not in ("bit", "byte"):
        raise ValueError(f"kind {kind!r}: planes are of bits or bytes")
    small_batches(docs.sparkSession)
    # rows that are equal in id and text may come in any order: their ids are the same
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, blocks = _encoder(tokenizer), _Blocks(TaskContext.get().partitionId(), block, kind, level)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, "right")))
                ids, bounds = encoder.encode(texts.slice(begin, end - begin))
                closed = np.insert(ids, bounds[1:], end_id)
                blocks.add(closed, doc_ids.slice(begin, end - begin).to_pylist(), np.diff(bounds) + 1)
                if (out := blocks.take()) is not None:
                    yield out
                begin = end
        if (out := blocks.take(all_of_it=True)) is not None:
            yield out
        give_back()

    spark = docs.sparkSession
    dealt.mapInArrow(encoded, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # one row for each task that wrote
    totals = blocks.groupBy("part").agg(F.sum("n").cast("long").alias("ids"))
    base = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(base, F.lit(0)).alias("base"), "ids").write.parquet(f"{path}/parts")
    octets = F.aggregate(F.transform("planes", lambda p: F.octet_length(p).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    index = blocks.withColumn("bytes", octets).join(F.broadcast(spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", "base")), "part")
    index.select("part", "block", (F.col("base") + F.col("first")).alias("first"), "n", "bytes").write.parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the blocks: (part, block, first, n, bytes), `first` counted from the start of all ids."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, first: int | None = None, end: int | None = None) -> DataFrame:
    """Pieces (doc_id, start, n_tokens, at, ids): what each block holds of each document.

    start: ids of all documents before it; n_tokens: its ids with the end id; at: ids of the document before the piece;
    ids: little-endian unsigned 32-bit numbers. With `first` and `end` only the ids from `first` to before `end` are read: their
    blocks are looked up in the index, and the comparison with literals reaches the scan. A block that does not match its
    checksum is an error.
    """
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    low, high = 0 if first is None else first, (1 << 62) if end is None else end
    if first is not None or end is not None:
        held = index(spark, path).where((F.col("first") < high) & (F.col("first") + F.col("n") > low))
        place = F.struct("part", "block")
        edge = held.agg(F.min(place).alias("a"), F.max(place).alias("b")).first()
        if edge.a is None or low >= high:
            blocks = blocks.where("false")
        else:
            after = (F.col("part") > edge.a.part) | ((F.col("part") == edge.a.part) & (F.col("block") >= edge.a.block))
            before = (F.col("part") < edge.b.part) | ((F.col("part") == edge.b.part) & (F.col("block") <= edge.b.block))
            blocks = blocks.where(F.col("part").between(edge.a.part, edge.b.part) & after & before)
    # one row for each task that wrote the files
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", "base")
    blocks = blocks.join(F.broadcast(parts), "part").select("base", "first", "n", "kind", "planes", "crc", "docs")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, begin, n, kind, planes, crc, docs = (batch.column(c)[row].as_py() for c in range(7))
                ids = from_planes(planes, n, kind)
                if zlib.crc32(ids.tobytes()) != crc:
                    raise ValueError(f"the block at {base + begin} is damaged")
                cuts = [(max(d["start"], begin, low - base), min(d["start"] + d["n"], begin + n, high - base)) for d in docs]
                kept = [(d, a, b) for d, (a, b) in zip(docs, cuts) if a < b]
                columns = [
                    pa.array([d["doc_id"] for d, _, _ in kept], pa.int64()),
                    pa.array([base + d["start"] for d, _, _ in kept], pa.int64()),
                    pa.array([d["n"] for d, _, _ in kept], pa.int64()),
                    pa.array([a - d["start"] for d, a, _ in kept], pa.int64()),
                    pa.array([ids[a - begin : b - begin].tobytes() for _, a, b in kept], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "at", "ids"])

    return blocks.mapInArrow(opened, "doc_id long, start long, n_tokens long, at long, ids binary")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of whole documents, read back from the files.

    Only documents that lie in several blocks are shuffled, and each is put together by itself.
    """
    pieces = read(spark, path)
    whole = F.octet_length("ids") == 4 * F.col("n_tokens")

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        data = table.column("ids").to_pylist()
        return table.slice(0, 1).select(["doc_id", "start", "n_tokens"]).append_column("ids", pa.array([b"".join(data[i] for i in order)], pa.binary()))

    split = pieces.where(~whole).groupBy("start").applyInArrow(joined, "doc_id long, start long, n_tokens long, ids binary")
    return pieces.where(whole).select("doc_id", "start", "n_tokens", "ids").unionByName(split)
