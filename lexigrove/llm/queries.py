"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embedding, html, langid, mix, negatives, packing, pii, planes, quality, simhash, substring, urlfilter
from .common import shared_dir, table

#: A key for the queries; jobs pass their own secret.
PII_KEY = "a key for tests"

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learned = langid.sample(docs.where(fold != 0).select("doc_id", "text", "lang"))
    return langid.predict(docs, learned, keep=(F.coalesce(fold == 0, F.lit(False)).alias("held_out"),))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_changed")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/lexigrove/ids-{uuid.uuid4().hex}"
    planes.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return planes.documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_language_id,
        op3_substring_dedup,
        op4_url_filter,
        op5_simhash,
        op6_quality_rules,
        op7_packing,
        op8_html_text,
        op9_embedding_dedup,
        op10_pii_pseudonyms,
        op11_token_planes,
        op12_hard_negatives,
        op13_source_divergence,
    )
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_URLS = f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, q, v) AS (VALUES {_RULES}),
m AS (SELECT p.*, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS n FROM p LEFT JOIN r ON host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1"""

_CLASSES = ["[a-z]", "\\p{Ll}", "\\p{Lu}", "\\p{Nd}", "[\\x20\\x09-\\x0D]", "[.,;:!?''\"()-]", "[#*$%&|<>]"]
_CUT = "".join(f", c{i} AS (SELECT *, regexp_replace(t{i}, '{p}', '', 'g') AS t{i + 1} FROM {f'c{i - 1}' if i else 'd'})" for i, p in enumerate(_CLASSES))
_CHARS = ", ".join([f"length(t{i}) - length(t{i + 1})" for i in range(7)] + ["length(t7)"])
_BINS = "[" + ", ".join(f"'{w}'" for w in quality.BINS) + "]"


def _js(p: str, q: str) -> str:
    """The distance of two lists of counts in SQL, null without counts."""
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(a, b)} + {part(b, a)})) / 2)) END"


_R = quality.Rules()
_QUALITY = f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t0 FROM documents){_CUT},
w AS (SELECT *, list_filter(regexp_split_to_array(t0, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM c6),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS h FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(ws) AS n_words, length(t0) - (length(t4) - length(t5)) AS word_chars, length(t6) - length(t7) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, [{_CHARS}] AS ch,
  list_transform({_BINS}, lambda b: len(list_filter(ws, lambda x: lower(x) = b))) AS cw FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed, list_append(cw, n_words - list_sum(cw)) AS cm FROM f),
e AS (SELECT lang, unnest(range(1, len(cm) + 1)) AS i, unnest(cm) AS c, unnest(list_concat(ch, list_transform(range(1, len(cm) - 7), lambda z: NULL))) AS x, doc_id FROM b WHERE NOT base_failed AND n_words >= {_R.guard_words} AND lang IS NOT NULL),
s AS (SELECT lang, i, sum(c)::DOUBLE AS c, sum(x)::DOUBLE AS x, count(DISTINCT doc_id) AS n FROM e GROUP BY lang, i),
v AS (SELECT lang, list(c ORDER BY i) AS rm, list(x ORDER BY i) FILTER (i <= 8) AS rc FROM s GROUP BY lang HAVING max(n) >= {_R.guard_reference}),
j AS (SELECT b.*, rc, rm, [n_words - cm[-1], cm[-1]] AS m2, [list_sum(rm) - rm[-1], rm[-1]] AS r2 FROM b LEFT JOIN v USING (lang)),
z AS (SELECT *, CASE WHEN list_sum(ch) >= {_R.guard_chars} THEN {_js("ch", "rc")} END AS cd, CASE WHEN n_words >= {_R.guard_words} THEN {_js("cm", "rm")} END AS wd, CASE WHEN n_words >= {_R.guard_words} THEN {_js("m2", "r2")} END AS md FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(cd > {_R.char_distance}, false) OR coalesce(wd > {_R.word_distance} AND md > {_R.mass_distance}, false)) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance, round(md, 6) AS mass_distance FROM z"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS root, a AS id FROM l UNION SELECT root, l.b FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON id = vec_id"""

_NEGATIVES = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""

_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(m.total, 0) + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN m USING (lang, source) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER w)::INTEGER AS rank FROM r WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 10"""

#: The others hash with functions that SQL lacks, or learn, parse and pack; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op4_url_filter": _URLS, "op6_quality_rules": _QUALITY, "op9_embedding_dedup": _VECTORS, "op12_hard_negatives": _NEGATIVES, "op13_source_divergence": _DIVERGENCE}
