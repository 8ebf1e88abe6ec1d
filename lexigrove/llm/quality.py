"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those of its language,
which are summed over the table's own documents that pass the plain rules. A document whose Jensen-Shannon distance
(base 2, so 0 to 1) to a reference is above a threshold is rejected. For words it must also be far when all common words
are one bin: a text that mixes languages has other common words than its language, but about as many. Guards: short documents have too few words or
characters for a histogram, and rare languages have no reference; neither is judged by divergence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged, words

# Common words of each language, about the most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on", "be", "by", "at", "are", "was", "this", "from", "or", "an", "a"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "für", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "plus", "ne", "se"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"],
}
BINS = sorted({w for ws in COMMON_WORDS.values() for w in ws})


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    char_distance: float = 0.24
    word_distance: float = 0.27
    mass_distance: float = 0.22
    guard_chars: int = 500  # fewer characters: no verdict by characters
    guard_words: int = 80  # fewer words: no verdict by words
    guard_reference: int = 20  # fewer documents in a language: no reference


def _sum(array) -> F.Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __chars and __commons (arrays of long)."""
    f = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    # each class is cut out in turn, so the later ones read a short rest
    classes = ["[a-z]+", r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", SPACE + "+", "[.,;:!?'\"()-]+", r"[#*$%&|<>]+"]
    for i, pattern in enumerate(classes):
        f = f.withColumn(f"__t{i}", F.regexp_replace("__t" if i == 0 else f"__t{i - 1}", pattern, ""))
    lengths = [F.length("__t"), *[F.length(f"__t{i}") for i in range(len(classes))]]
    counts = [(a - b).cast("long") for a, b in zip(lengths, lengths[1:])] + [lengths[-1].cast("long")]
    f = f.withColumns({"__chars": F.array(*counts), "__word_chars": (lengths[0] - counts[4]).cast("long"), "__n_symbols": counts[6]})
    f = f.drop(*[f"__t{i}" for i in range(len(classes))]).withColumns({"__w": words(F.col("__t")), "__lines": F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^" + SPACE[1:]))})
    f = f.withColumns({"__n_words": F.size("__w").cast("long"), "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__lines", "__t")
    f = f.withColumn("__common", F.transform(F.filter("__w", lambda x: F.lower(x).isin(BINS)), F.lower))
    f = f.withColumn("__commons", F.array(*[(F.size("__common") - F.size(F.array_remove("__common", w))).cast("long") for w in BINS]))
    f = f.withColumn("__commons", F.concat("__commons", F.array(F.col("__n_words") - F.size("__common")))).drop("__common")
    # three-word windows; positions of those that occur twice, then the words under them
    f = f.withColumn("__h", F.when(F.size("__w") >= 3, F.expr("transform(sequence(0, size(__w) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2)))")).otherwise(F.array().cast("array<long>"))).drop("__w")
    f = f.withColumn("__s", F.sort_array("__h"))
    f = f.withColumn("__d", F.expr("array_distinct(filter(__s, (x, i) -> i > 0 and x = get(__s, i - 1)))")).drop("__s")
    few = F.expr("filter(sequence(0, size(__h) - 1), i -> array_contains(__d, get(__h, i)))")
    f = f.withColumn("__p", F.when(F.size("__d") == 0, F.array().cast("array<int>")).when(F.size("__d") <= 48, few))
    f = f.withColumn("__o", F.when(F.col("__p").isNull(), F.expr("array_sort(transform(__h, (x, i) -> struct(x as h, i as i)))")))
    many = F.expr("array_sort(transform(filter(__o, (x, i) -> coalesce(x.h = get(__o, i - 1).h, false) or coalesce(x.h = get(__o, i + 1).h, false)), x -> x.i))")
    f = f.withColumn("__p", F.coalesce("__p", many)).drop("__o", "__h", "__d")
    return f.withColumn("__n_repeat_words", F.expr("aggregate(transform(__p, (x, i) -> least(3, coalesce(get(__p, i + 1) - x, 3))), 0L, (s, x) -> s + x)")).drop("__p")


def js_distance(p: str, q: str, n_p: str, n_q: str) -> F.Column:
    """Jensen-Shannon distance of two columns of counts, given their sums; null if either has no counts."""

    def term(x, y):
        a, b = x / F.col(n_p), y / F.col(n_q)
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.col(n_p) > 0) & (F.col(n_q) > 0), F.sqrt(F.greatest(F.lit(0.0), total / 2)))


def base_failed(rules: Rules) -> F.Column:
    return (F.col("__n_words") < rules.min_words) | (100 * F.col("__n_repeat_words") > rules.max_repeat_percent * F.col("__n_words"))


def judged(docs: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, mass_distance.

    Null texts are empty, so they fail. A null or rare language has no reference: the plain rules decide alone. Repeated
    rows are judged each; an empty table gives an empty result; columns not in `keep` are left out and cannot clash.
    """
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    f = features(rows, "__text").drop("__text").withColumn("__failed", base_failed(rules))
    # sums are columns of the staged tables: inside a lambda they would be added up again for each element
    f = staged(f.withColumns({f"__sum{c}": _sum(F.col(c)) for c in ("__chars", "__commons")}), "quality-features")
    sums = {"__chars": 8, "__commons": len(BINS) + 1}
    fit = f.where(~F.col("__failed") & (F.col("__n_words") >= rules.guard_words) & F.col("__lang").isNotNull())
    totals = fit.groupBy("__lang").agg(F.count("*").alias("__n"), *[F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c, n in sums.items() for i in range(n)])
    refs = totals.where(F.col("__n") >= rules.guard_reference).select("__lang", *[F.array(*[F.col(f"{c}_{i}") for i in range(n)]).alias(f"{c}_ref") for c, n in sums.items()])
    refs = staged(refs.withColumns({f"__sum{c}": _sum(F.col(c)) for c in ("__chars_ref", "__commons_ref")}), "quality-references")
    out = f.join(refs, "__lang", "left")
    out = out.withColumns({f"{c}_mass": F.array(F.col(f"__sum{c}") - F.element_at(c, -1), F.element_at(c, -1)) for c in ("__commons", "__commons_ref")})
    far_from = lambda p, q, n: js_distance(p, q, f"__sum{n}", f"__sum{n}_ref")
    enough = {"char_distance": F.col("__sum__chars") >= rules.guard_chars, "word_distance": F.col("__n_words") >= rules.guard_words, "mass_distance": F.col("__n_words") >= rules.guard_words}
    of = {"char_distance": ("__chars", "__chars_ref", "__chars"), "word_distance": ("__commons", "__commons_ref", "__commons"), "mass_distance": ("__commons_mass", "__commons_ref_mass", "__commons")}
    out = out.withColumns({c: F.when(enough[c], far_from(*of[c])) for c in of})
    far_words = (F.col("word_distance") > rules.word_distance) & (F.col("mass_distance") > rules.mass_distance)
    far = F.coalesce(F.col("char_distance") > rules.char_distance, F.lit(False)) | F.coalesce(far_words, F.lit(False))
    return out.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__failed").alias("base_failed"), (~F.col("__failed") & ~far).alias("kept"), *[F.round(c, 6).alias(c) for c in ("char_distance", "word_distance", "mass_distance")],
    )


def kept(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns. Rows are judged in place: nothing is joined back by id."""
    names = docs.columns
    own = {c: f"d{i}" for i, c in enumerate(names)}  # the columns under names of their own, since some may be those of the verdict
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    out = judged(rows, rules, own["lang"], own["text"], tuple(own.values()))
    return out.where("kept").select(*[F.col(n).alias(c) for c, n in own.items()])
