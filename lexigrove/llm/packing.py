"""Packing token sequences by first-fit decreasing with a tournament tree.

Documents are encoded, and dealt at random into groups of about `group_docs`; each group is packed by itself. What is
longer than a sequence is cut into whole sequences; the rests, longest first, go into the first sequence with room, which
a tournament tree of free room finds in log(n) steps. Then the emptiest sequences are dissolved into the gaps of the
fullest, as far as a gap is worth a cut, and the one sequence left over in a group is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Words whose ids a Python worker remembers, and bytes of text it encodes at a time.
REMEMBERED, SLICE = 250_000, 4 << 20
#: Words that the merges can encode: letters of Latin-1, for which lower case and normal form are plain.
SIMPLE = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


class Merges:
    """Byte-pair merges of many words at once.

    In each round every word merges its pair of lowest rank, the leftmost of equals, until no word has one; that is
    byte-pair encoding word by word, with the loop over the words in numpy. A hash table of two probes holds the pairs.
    """

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # bytes are written as printable characters: those of Latin-1 that are, and then the next free code points
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.made = np.append(made, 0)
        self.tables, left = [], np.arange(len(key))
        while len(left):
            table, shift = np.full(1 << 20, self.none, np.int32), len(self.tables)
            slot = self._slot(key[left], shift)
            table[slot[::-1]] = left[::-1]
            left = left[table[slot] != left]
            self.tables.append(table)
        self.key = np.append(key, -1)

    @staticmethod
    def _slot(key: np.ndarray, shift: int) -> np.ndarray:
        return ((key * (0x9E3779B97F4A7C1 + 2 * shift)) >> 24) & ((1 << 20) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; `none` if it does not merge."""
        key, rank = a << 16 | b, np.full(len(a), self.none)
        for shift, table in enumerate(self.tables):
            found = table[self._slot(key, shift)]
            rank = np.where(self.key[found] == key, found, rank)
        return rank

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each has); no word is empty."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(words):
            return np.zeros(0, np.int64), sizes
        begin = words.offset
        offsets = np.frombuffer(words.buffers()[1], np.int32)[begin : begin + len(words) + 1]
        octets = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        symbol = self.inner[octets]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[octets[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        out_symbol, out_word = [], []
        rank = np.full(len(symbol), self.none)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank * (1 << 32) + np.arange(len(rank)), first)
            alive = best >> 32 < self.none
            if not alive.all():  # finished words leave
                lengths = np.diff(np.append(first, len(word)))
                stay = np.repeat(alive, lengths)
                out_symbol.append(symbol[~stay])
                out_word.append(word[~stay])
                moved = np.cumsum(stay) - 1
                symbol, word, rank = symbol[stay], word[stay], rank[stay]
                at = moved[best[alive] & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(at):
                break
            symbol[at] = self.made[rank[at]]
            gone = np.ones(len(symbol), bool)
            gone[at + 1] = False
            at = (np.cumsum(gone) - 1)[at]
            symbol, word, rank = symbol[gone], word[gone], rank[gone]
            before = at[(at > 0)] - 1
            before = before[word[before] == word[before + 1]]
            rank[before] = self.rank(symbol[before], symbol[before + 1])
            rank[at] = self.none
            on = at[at + 1 < len(symbol)]
            on = on[word[on] == word[on + 1]]
            rank[on] = self.rank(symbol[on], symbol[on + 1])
        symbol, word = np.concatenate([np.zeros(0, np.int64), *out_symbol]), np.concatenate([np.zeros(0, np.int64), *out_word])
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Encoder:
    """Token ids of whole columns of texts.

    The vocabulary's words end at white space, so each distinct word is encoded once and the ids are put together
    by numpy; the result is that of `Tokenizer.encode` on the text. Words of plain letters are merged by numpy too, all other
    words by the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are shuffled in two bytes each; the vocabulary has more")
        self.merges = Merges(json.loads(self.tokenizer.to_str())["model"])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def learn(self, words: list[str]) -> None:
        """The ids of new words: letters by the merges, all others by the tokenizer."""
        array = pa.array(words, pa.string())
        plain = pc.match_substring_regex(array, SIMPLE)
        simple, other = array.filter(plain), array.filter(pc.invert(plain)).to_pylist()
        ids, sizes = self.merges.encode(pc.utf8_lower(simple))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        more = np.array([i for own in found for i in own], np.int64)
        self._add(simple.to_pylist() + other, np.concatenate([ids, more]), np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))]))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint16)])

    def _gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after the other, and where each ends."""
        each = self.sizes[words]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[words] - (ends - each), each)
        return self.flat[at], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]; null is empty."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # lower case could make a special token of such a text
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,;!?])", r"\1 \2")  # a mark after a letter is a word of its own
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self.learn(new)
        if not len(codes):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        words = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[codes]
        ids, ends = self._gather(words)
        return ids, np.concatenate([[0], ends])[offsets]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class RoomTree:
    """A tournament tree: leaves hold the free room of the bins, inner nodes the larger of their two."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for `size`, which then has that much less."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        found = node - self.leaves
        most[node] -= size
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
        return found


def pack_lengths(lengths: list[int], capacity: int = 4096, least_gap: int = 8) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length): every token of every item lies in exactly one piece.

    Items of length 0 have no piece. All sequences are `capacity` long at most; each but a few is nearly full.
    """
    whole, rests = [], []
    for i, n in enumerate(lengths):
        whole += [[(i, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rests.append((n % capacity, i))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = RoomTree(len(rests), capacity), {}
    for n, i in rests:
        bins.setdefault(tree.take(n), []).append((i, lengths[i] - n, n))
    filled = [(sum(p[2] for p in b), b) for b in bins.values()]
    out = whole + [b for n, b in filled if capacity - n < least_gap]
    gaps = sorted(((n, b) for n, b in filled if capacity - n >= least_gap), key=lambda x: (x[0], x[1]))
    left: list[tuple[int, int, int]] = []  # of the bins dissolved so far
    low, high = 0, len(gaps) - 1
    while low <= high:
        n, b = gaps[high]
        while n < capacity:
            if not left:
                if low >= high:
                    break
                left = gaps[low][1][::-1]
                low += 1
            i, s, size = left.pop()
            part = min(size, capacity - n)
            b.append((i, s, part))
            n += part
            if part < size:
                left.append((i, s + part, size - part))
        if n == capacity or low < high:
            out.append(b)
        else:
            left = b[::-1] + left
        high -= 1
    # the last sequence of the group, cut at powers of two
    rest = sum(p[2] for p in left)
    left = left[::-1]
    while rest:
        if rest < capacity:
            room = 1 << (rest.bit_length() - 1)
        else:
            room = capacity
        rest -= room
        sequence = []
        while room:
            i, s, size = left.pop(0)
            part = min(size, room)
            sequence.append((i, s, part))
            room -= part
            if part < size:
                left.insert(0, (i, s + part, size - part))
        out.append(sequence)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (splitmix64's finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, group_bytes: int = 6 << 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset), one for each piece of a document.

    ids: the piece's token ids as little-endian unsigned 32-bit numbers; doc_tokens counts the end id. Null texts are
    empty and have the end id alone; null ids are kept; repeated rows are packed each. Groups are sized by bytes of text
    and drawn by a hash of task, id, text and number among equal rows, so that one id on many rows fills no single group,
    and a task that is run again deals the same rows to the same groups, in whatever order they come. Other columns are
    left out. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n"), F.count("*").alias("rows")).first()
    groups = max(1, -(-((size["n"] or 0) + 64 * size["rows"]) // group_bytes))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = np.uint64(TaskContext.get().partitionId()), Counter()
        encoder = _encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, "right")))
                tokens, bounds = encoder.encode(texts.slice(begin, end - begin))
                data = [tokens[a:b].astype("<u2").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]  # two bytes an id for the shuffle
                own = pc.fill_null(ids.slice(begin, end - begin), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                rows = _mixed(_mixed(own + np.uint64(seed)) ^ np.array([xxhash.xxh64_intdigest(x) for x in data], np.uint64))
                nth = []
                for row in rows.tolist():
                    nth.append(seen[row])
                    seen[row] += 1
                dealt = _mixed(rows ^ (np.array(nth, np.uint64) + (task << np.uint64(40)))) % np.uint64(groups)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array(dealt.astype(np.int64)), pa.array(data, pa.binary())], ["doc_id", "dealt", "ids"])
                begin = end
        give_back()

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        ids = table.column("doc_id").combine_chunks()
        data = table.column("ids").to_pylist()
        order = sorted(range(len(data)), key=lambda i: (ids[i].as_py() is not None, ids[i].as_py() or 0, data[i]))
        lengths = [len(data[i]) // 2 + 1 for i in order]
        rows, starts, sizes, parts, sequences, offsets = [], [], [], [], [], []
        for k, sequence in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i, s, n in sequence:
                piece = np.frombuffer(data[order[i]], "<u2")[s : s + n].astype("<u4")
                if s + n == lengths[i]:
                    piece = np.append(piece, np.uint32(end_id)).astype("<u4")
                rows.append(i), starts.append(s), sizes.append(n), parts.append(piece.tobytes()), sequences.append((group << 32) + k), offsets.append(at)
                at += n
        own = pa.array([order[i] for i in rows], pa.int64())
        long = lambda x: pa.array(x, pa.int64())
        return pa.table([ids.take(own), long(starts), long(sizes), pa.array(parts, pa.binary()), long([lengths[i] for i in rows]), long(sequences), long(offsets)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, "doc_id long, dealt long, ids binary")
    return rows.groupBy("dealt").applyInArrow(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

