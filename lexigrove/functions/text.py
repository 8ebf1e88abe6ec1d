"""Column functions on text: cleaning, folding, tokens, locators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are dropped, and lines that are noise.
INVISIBLE = r"[​‌‍‎‏­﻿\x0c\x0b\x00-\x08\x0e-\x1f\x7f]"
PAGE_LINES = [r"^\s*[Tt]rang\s+\d+\s*/\s*\d+\s*$", r"^\s*-{2,}\s*[Pp]age\s+\d+\s*-{2,}\s*$", r"^\s*\d+\s*$", r"^(?iu)\s*(Người ký:|Email:.*?Cơ quan:|CÔNG BÁO/Số).*$"]
DANGLING = r"^\s*(?:\d+\.|[a-zđA-ZĐ]\))\s*$"
# Beginnings of structural lines.
STRUCTURAL = [r"^Chương\s+[IVXLCDM\d]+", r"^Mục\s+\d+", r"^(?:Đ|Ð)iều\s+\d+", r"^\d+\.\s", r"^[a-zđ]\)\s"]
# Stop words of question tokens and of lexical tokens, both without accents.
QUESTION_STOPWORDS = ["cua", "cho", "voi", "theo", "trong", "duoc", "nhung", "cac", "khi", "nay", "la", "va", "co", "gi", "nao", "phai", "ve", "doi", "tai"]
LEXICAL_STOPWORDS = ["va", "la", "cua", "co", "duoc", "thi", "theo", "nay", "do", "mot", "nhung", "cac", "cho", "tai", "trong", "khi", "ve", "voi", "phai"]
# Texts that stand for nothing.
PLACEHOLDERS = ["", "n/a", "na", "none", "null", "unknown", "test", "...", "không có", "khong co", "n.a", "không xác định", "ko co"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(line) -> Column:
    return F.trim(F.regexp_replace(_c(line), r"\s+", " ")) == ""


def clean_line(line) -> Column:
    """Invisible characters go, runs of spaces and tabs are one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(line), INVISIBLE, ""), r"[ \t]+", " "))


def is_noise(line) -> Column:
    """Page numbers, page marks and signature lines."""
    found = _c(line).rlike(PAGE_LINES[0])
    for p in PAGE_LINES[1:]:
        found = found | _c(line).rlike(p)
    return found


def is_dangling(line) -> Column:
    """A line that is only a clause number or point letter."""
    return _c(line).rlike(DANGLING)


def is_structural(line) -> Column:
    found = _c(line).rlike(STRUCTURAL[0])
    for p in STRUCTURAL[1:]:
        found = found | _c(line).rlike(p)
    return found


def by_rows(f, type_: str):
    """A UDF over pickled rows, a hundred at a time: whole texts in Arrow batches of 10,000 take a worker hundreds of MB."""
    return F.udf(f, type_, useArrow=False)


def nfc(text) -> Column:
    """Unicode NFC. Spark has no such function, so it is a UDF by rows; plain ASCII, which NFC leaves alone, does not reach it."""
    normal = by_rows(lambda t: None if t is None else unicodedata.normalize("NFC", t), "string")

    return F.when(_c(text).rlike(r"^[\x00-\x7f]*\z"), _c(text)).otherwise(normal(_c(text)))


def nfc_changes(text) -> Column:
    """struct(text, changed): NFC, and the number of characters that differ place by place, with the difference in length."""

    def changes(t: str | None) -> tuple[str | None, int]:
        new = None if t is None else unicodedata.normalize("NFC", t)
        return new, 0 if t is None else sum(map(str.__ne__, t, new)) + abs(len(t) - len(new))

    return by_rows(changes, "text string, changed long")(_c(text))


def is_nfc(text) -> Column:
    return _c(text) == nfc(text)


def fold(text) -> Column:
    """Case folded, accents dropped, đ as d."""

    def folded(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d")

    return F.when(_c(text).rlike(r"^[\x00-\x7f]*\z"), F.lower(_c(text))).otherwise(by_rows(folded, "string")(_c(text)))


def fold_keeping_d(text) -> Column:
    """As `fold`, but đ stays, so that it parts lexical tokens."""

    def folded(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if unicodedata.category(c) != "Mn")

    return F.when(_c(text).rlike(r"^[\x00-\x7f]*\z"), F.lower(_c(text))).otherwise(by_rows(folded, "string")(_c(text)))


def token_set(text) -> Column:
    """Distinct folded tokens of over two characters without stop words, in order of first use."""
    found = F.regexp_extract_all(fold(text), F.lit("([a-z0-9]+)"))
    return F.array_except(F.filter(F.array_distinct(found), lambda t: F.length(t) > 2), F.array(*map(F.lit, QUESTION_STOPWORDS)))


def lexical_tokens(text) -> Column:
    """Folded tokens of over one character without stop words, with repeats."""
    found = F.regexp_extract_all(fold_keeping_d(text), F.lit("([a-z0-9]+)"))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(LEXICAL_STOPWORDS))


def evidence_tokens(text) -> Column:
    """Distinct words of over two characters, accents kept."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(nfc(text)), F.lit(r"(?U)(\w+)"))), lambda t: F.length(t) > 2)


#: Texts of these characters are NFC: none of them changes, combines or goes together with one before it.
NFC_ALREADY = r"^[\x00-\u02ff\u1e00-\u1eff]*\z"


def nfc_all(texts: Column, plain: Column) -> Column:
    """NFC of arrays of arrays of texts; where `plain` tells that all are NFC already they stay and are not sent to Python."""

    def normal(rows):
        return None if rows is None else [None if ts is None else [None if t is None else unicodedata.normalize("NFC", t) for t in ts] for ts in rows]

    return F.when(plain, texts).otherwise(by_rows(normal, "array<array<string>>")(F.when(~plain, texts)))


def squeezed_nfc(text) -> Column:
    """A text that is NFC, in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", " "))


def squeezed(text) -> Column:
    """Lower case NFC with single spaces."""
    return squeezed_nfc(nfc(text))


def quality_text(text) -> Column:
    return F.coalesce(squeezed(text), F.lit(""))


def is_placeholder(text) -> Column:
    return quality_text(text).isin(PLACEHOLDERS)


def has_alnum(text) -> Column:
    return F.coalesce(_c(text).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def is_valid_evidence(text) -> Column:
    return ~is_placeholder(text) & has_alnum(text)


def marker_slug(marker) -> Column:
    """Lower case, đ as dd, only a-z, 0-9 and hyphens; `unknown` if nothing is left."""
    slug = F.regexp_replace(F.replace(F.lower(F.trim(_c(marker))), F.lit("đ"), F.lit("dd")), r"[^a-z0-9\-]", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def estimated_tokens(text) -> Column:
    """A third of the characters, rounded up; at least one for a text that is not empty."""
    n = F.length(_c(text))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor((n + 2) / 3)))


# Locators. The law's prefix and code are parameters.
def locator_of(node_id, law: str = "LD2024") -> Column:
    """`.._dieu-5_khoan-2_diem-dd..` to `LD2024:A5:K2:Dđ`; null without an article."""
    part = lambda p: F.regexp_extract(_c(node_id), p, 1)
    article, clause, point = part(r"_dieu-(\d+)"), part(r"_dieu-\d+.*?_khoan-(\d+)"), part(r"_diem-([a-z]+)")
    letter = F.when(point == "dd", F.lit("đ")).otherwise(point)
    return F.when(article != "", F.concat(F.lit(f"{law}:A"), article, F.when(clause != "", F.concat(F.lit(":K"), clause)).otherwise(""), F.when(point != "", F.concat(F.lit(":D"), letter)).otherwise("")))


def locator_parts(locator, law: str = "LD2024") -> Column:
    """struct(article, clause, point), null where a part is not given or the whole is no locator."""
    whole = rf"^{law}:A(\d+)(?::K(\d+))?(?::D([a-zđ]))?\z"
    part = lambda i: F.nullif(F.regexp_extract(_c(locator), whole, i), F.lit(""))
    return F.struct(part(1).alias("article"), part(2).alias("clause"), part(3).alias("point"))


def article_id(locator, law_code: str = "31/2024/qh15", law: str = "LD2024") -> Column:
    n = F.regexp_extract(_c(locator), rf"^{law}:A(\d+)", 1)
    return F.when(n != "", F.concat(F.lit(f"{law_code}#"), n))


def locator_text(locator, law: str = "LD2024", fallback: str = "vị trí chưa xác định") -> Column:
    """The locator in words: point, clause, article."""
    p = locator_parts(locator, law)
    words = F.concat_ws(" ", F.concat(F.lit("điểm "), p["point"]), F.concat(F.lit("khoản "), p["clause"]), F.concat(F.lit("Điều "), p["article"]))
    return F.when(p["article"].isNotNull(), words).otherwise(F.lit(fallback))


def related(left, right) -> Column:
    """Equal locators, or one within the other."""
    a, b = _c(left), _c(right)
    return (a == b) | F.startswith(a, F.concat(b, F.lit(":"))) | F.startswith(b, F.concat(a, F.lit(":")))


def locator_depth(locator) -> Column:
    return F.contains(_c(locator), F.lit(":K")).cast("int") + F.contains(_c(locator), F.lit(":D")).cast("int")
