"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is parsed with it into longest
matches: a phrase goes on while it occurs in the sample, and the next begins where it ends. The language that needs the
fewest phrases, times the bits that point to a phrase in its sample, wins.

The sample is bounded by parameters (`documents` per language, one random window of `window` characters in each, fewer
where there are many languages). All text of all documents is then parsed, many stretches at once, one step of all the
automata for each character, in numpy; the phrases are those of whole texts read through from the beginning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sampled characters in all languages together, at most.
TOTAL = 1 << 20
#: Characters of a stretch, and stretches parsed at a time in all languages together.
STRETCH, LANES = 512, 1 << 14
#: Characters, times languages, of the texts that are parsed together.
AT_ONCE = 1 << 24
LETTER = re.compile(r"[^\W\d_]")


def sample(labelled: DataFrame, documents: int = 64, window: int = 400, languages: int = 1024, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """A bounded sample of labelled rows for each language; rows with a null id, text or language are not sampled.

    Of more than `languages` languages the commonest are learned, of equally common ones the first by name. Documents are
    drawn by a hash of the id. The row numbers are limited before the shuffle (a window group limit), the drawn ids, TOTAL
    / window at most, are sent to the rows, and only the drawn windows reach the driver: `documents * window` characters a
    language, TOTAL in all. No text is shuffled but these.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    languages = max(1, min(languages, TOTAL // window))
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    documents = max(1, min(documents, TOTAL // window // max(1, len(known))))
    drawn = (
        rows.where(F.col("lang").isin(known))
        .select("id", "lang", F.xxhash64("id", F.lit(seed)).alias("h"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
        .where(F.col("n") <= documents)
        .select("id", "lang", "h")
        .distinct()
    )
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - window, F.lit(1))) + 1
    windows = rows.join(F.broadcast(drawn), ["id", "lang"]).select("lang", "id", F.col("text").substr(begin.cast("int"), F.lit(window)).alias("window")).groupBy("lang", "id").agg(F.min("window").alias("window"))
    found: dict[str, list[str]] = {}
    for r in windows.orderBy("lang", "id").collect():
        found.setdefault(r["lang"], []).append(r["window"])
    return found


class Automata:
    """The suffix automata of all languages in one comb: the rows of all states laid over each other where they leave gaps.

    A state is the place where its row begins. The entry at state + symbol holds the state that owns it, in its upper
    half, and the next state; an entry with another owner means that there is no such transition. So the alphabet, all
    characters of the samples, costs nothing for states that go on with few of them.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        counts = Counter(c for texts in samples.values() for t in texts for c in t.lower())
        symbols = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if not c.isspace()]
        self.code = np.ones(0x110000, np.int32)  # 0 stands between texts and for the end, 1 for characters that no sample has, 2 for white space
        for c in map(chr, range(0x3001)):
            if c.isspace():
                self.code[ord(c)] = 2
        for i, c in enumerate(symbols):
            for x in (c.title(), c.upper(), c):
                if len(x) == 1:
                    self.code[ord(x)] = i + 3
        width = len(symbols) + 3
        used, self.bits, self.starts = 0, [], []
        tables, roots = [], []
        for lang in self.languages:
            codes = np.concatenate([np.append(self.codes(t), 0) for t in samples[lang]]).tolist()
            states = _suffix_automaton(codes)
            places, size = _comb(states, width)
            table, root = np.full(size, -1 << 32, np.int64), np.full(width, used + places[0], np.int64)
            for s, nexts in enumerate(states):
                for c, to in nexts.items():
                    if c:
                        table[places[s] + c] = (used + places[s]) << 32 | (used + places[to])
            for c, to in states[0].items():
                if c:
                    root[c] = used + places[to]
            tables.append(table)
            roots.append(root)
            self.starts.append(used + places[0])
            self.bits.append(float(np.log2(len(codes) + 1)))
            used += size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.roots = np.stack(roots) if roots else np.zeros((0, width), np.int64)

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """The number of phrases of each text in each language."""
        codes, sizes = self.codes("".join(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
        at_once = max(1, AT_ONCE // max(1, len(codes)))
        parts = [self._phrases(codes, sizes, slice(i, i + at_once)) for i in range(0, len(self.languages), at_once)]
        return np.concatenate(parts, axis=1) if parts else np.ones((len(texts), 0), np.int64)

    def _phrases(self, codes: np.ndarray, sizes: np.ndarray, languages: slice) -> np.ndarray:
        """Texts are parsed in stretches side by side, as if each began a text; then each parse is carried on into the
        next stretch until a phrase of both begins at one place, from where on they are the same. So the phrases are
        those of the whole text read through.
        """
        roots, starts = self.roots[languages], np.array(self.starts[languages], np.int64)
        n = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        broke = np.zeros((len(starts), len(codes)), bool)  # where a phrase ends and the next begins
        ends = np.zeros((len(starts), len(owner)), np.int64)
        order = np.argsort(-length, kind="stable")
        lanes_at_once = max(64, LANES // len(starts))
        for a in range(0, len(order), lanes_at_once):
            lanes = order[a : a + lanes_at_once]
            at, size = begin[lanes], length[lanes]
            state = np.repeat(starts[:, None], len(lanes), axis=1)
            alive = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # lanes longer than t: they are sorted
            for t in range(int(size[0])):
                k = int(alive[t])
                c = codes[at[:k] + t]
                entry = self.table.take(state[:, :k] + c)
                goes = (entry >> 32) == state[:, :k]
                state[:, :k] = np.where(goes, entry & 0xFFFFFFFF, roots.take(c, axis=1))
                broke[:, at[:k] + t] = ~goes
            ends[:, lanes] = state
        # breaks[l, m]: those in stretch m of the parse that comes in from the stretch before, in language l
        own = np.zeros((len(starts), len(owner)), np.int64)
        for i, row in enumerate(broke):
            total = np.concatenate([[0], np.cumsum(row, dtype=np.int64)])
            own[i] = total[begin + length] - total[begin]
        breaks = own.copy()
        lang, m = (x.ravel() for x in np.meshgrid(np.arange(len(starts)), np.flatnonzero(nth > 0), indexing="ij"))
        state = ends[lang, m - 1]
        late: dict[tuple[int, int], dict[int, int]] = {}  # (language, text): stretches that a parse leaves without having met the stretch's own, and its state there
        while len(lang):
            met, count, left = self._carried(codes, begin[m], length[m], broke, lang, state, roots)
            breaks[lang, m] = count
            for i in np.flatnonzero(met).tolist():
                breaks[lang[i], m[i]] += int(broke[lang[i], begin[m[i]] + left[i] + 1 : begin[m[i]] + length[m[i]]].sum())
            for i in np.flatnonzero(~met).tolist():
                late.setdefault((int(lang[i]), int(owner[m[i]])), {})[int(m[i])] = int(left[i])
            following = []
            for key in list(late):
                k = min(late[key])
                s = late[key].pop(k)
                if not late[key]:
                    del late[key]
                if k + 1 < len(owner) and owner[k + 1] == key[1]:
                    late.get(key, {}).pop(k + 1, None)  # that came from a parse that is not the text's
                    following.append((key[0], k + 1, s))
            late = {k: v for k, v in late.items() if v}
            lang, m, state = (np.array([f[i] for f in following], np.int64) for i in range(3))
        counts = np.ones((len(sizes), len(starts)), np.int64)
        np.add.at(counts, owner, breaks.T)
        return counts

    def _carried(self, codes, begin, length, broke, lang, state, roots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parses that come into stretches: (whether they meet the stretch's own, breaks until then, the place or, if not met, the state)."""
        met, count, left = np.zeros(len(lang), bool), np.zeros(len(lang), np.int64), state.copy()
        on = np.arange(len(lang))
        for t in range(STRETCH):
            on = on[length[on] > t]
            if not len(on):
                break
            at, s, of = begin[on] + t, left[on], lang[on]
            c = codes[at]
            entry = self.table.take(s + c)
            goes = (entry >> 32) == s
            left[on] = np.where(goes, entry & 0xFFFFFFFF, roots[of, c])
            count[on] += ~goes
            same = ~goes & (broke[of, at] if t else True)
            met[on[same]] = True
            left[on[same]] = t
            on = on[~same]
        return met, count, left


def _comb(states: list[dict[int, int]], width: int) -> tuple[list[int], int]:
    """A place for the row of each state, no two alike, so that no two rows hold one entry; and the length of the whole.

    Large rows come first, each at the first place that suits it in steps of about 0.62 of the comb, which visit all
    places. The comb has room for three times the entries, so a few places are tried for a row.
    """
    rows = [[c for c in s if c] for s in states]
    room = 3 * max(len(states), sum(map(len, rows))) + 1
    step = int(0.618 * room) + 1
    while gcd(step, room) > 1:
        step += 1
    taken, begun, places, at = bytearray(room + width), bytearray(room), [0] * len(states), 0
    for s in sorted(range(len(states)), key=lambda s: -len(rows[s])):
        while begun[at] or any(taken[at + c] for c in rows[s]):
            at = (at + step) % room
        places[s], begun[at] = at, 1
        for c in rows[s]:
            taken[at + c] = 1
        at = (at + step) % room
    return places, room + width


def _suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; state 0 is the start. Symbol 0 separates texts and matches nothing later."""
    nexts, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


_built: dict[int, tuple[dict, Automata]] = {}


def _automata(samples: dict[str, list[str]]) -> Automata:
    key = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))
    if key not in _built:
        _built.clear()
        _built[key] = (samples, Automata(samples))
    return _built[key][1]


def identify(texts: list, automata: Automata) -> tuple[list[str], list[float]]:
    """Language and score of each text. Score: the share of the winner when a language weighs 2 to the minus its bits a character times 64."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    most = AT_ONCE // max(8, len(automata.languages))
    begin = 0
    while begin < len(own) and automata.languages:
        end, chars = begin, 0
        while end < len(own) and (end == begin or chars + len(texts[own[end]]) <= most):
            chars += len(texts[own[end]])
            end += 1
        part = own[begin:end]
        cost = automata.phrases([texts[i] for i in part]) * np.array(automata.bits)
        best = cost.argmin(axis=1)
        rate = (cost - cost.min(axis=1, keepdims=True)) / np.array([len(texts[i]) for i in part])[:, None]
        share = 1 / np.exp2(-np.minimum(64 * rate, 1000)).sum(axis=1)
        for i, b, s in zip(part, best, share):
            langs[i], scores[i] = automata.languages[b], float(s)
        begin = end
    return langs, scores


def predict(docs: DataFrame, samples: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Rows (doc_id, *keep, lang_pred, score), one for each row of `docs`.

    Null texts, and texts without a letter, are `und` with score 0; so is all if there is no sample. Ties go to the first
    language by name. Repeated rows are judged each; other columns are left out; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    @F.pandas_udf("lang string, score double")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = _automata(sent.value)
        for batch in batches:
            langs, scores = identify(batch.tolist(), automata)
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.select(F.col(id_col).alias("doc_id"), *keep, look(F.col(text_col)).alias("__found")).select("doc_id", *keep, F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"))
