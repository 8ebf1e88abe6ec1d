from pyspark.sql import functions as F

from lexigrove.operators import clean, parse
from lexigrove.schemas import PARAGRAPH


def lines(spark, text):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(text.split("\n"))], "doc string, idx int, line string")


def test_points_d_and_dd_differ(spark):
    n = parse.parse_text(lines(spark, "Điều 27. Test\nđ) Điểm đ thứ nhất\nđ) Điểm đ thứ hai")).collect()
    points = [r for r in n if r.type == "POINT"]
    article = next(r for r in n if r.type == "ARTICLE")
    assert len(n) == 3 and len({r.id for r in n}) == 3
    assert {r.parent_id for r in points} == {article.id} and all(r.implicit_parent for r in points)


def test_ids_are_the_same_on_each_run_and_partitioning(spark):
    df = lines(spark, "Điều 27. Test\n1. Khoản 1\na) Điểm a\nText lơ lửng")
    one = sorted(map(tuple, parse.parse_text(df).collect()))
    assert one == sorted(map(tuple, parse.parse_text(df.repartition(7)).collect()))
    assert [r[4] for r in one if r[1] == "POINT"] == ["Điểm a\nText lơ lửng"]


def test_scope_list_style_and_hints(spark):
    rows = [
        ("d", 0, "Điều 1. A", None, None, None, None, None, None, False),
        ("d", 1, "no number", "List Paragraph", None, None, None, None, None, False),
        ("d", 2, "still none", "ListParagraph", None, 1, "lowerLetter", None, None, False),
        ("d", 3, "numbered", None, None, 0, "decimal", "4", None, False),
        ("d", 4, "plain", None, None, None, None, None, None, False),
    ]
    got = {r["index"]: r.match for r in parse.with_contract_metadata(parse.classify(spark.createDataFrame(rows, PARAGRAPH))).collect()}
    assert got[0].type == "ARTICLE" and got[0].title == "A"
    assert got[1].type == "CLAUSE"
    assert got[2].type == "POINT"
    assert (got[3].type, got[3].number) == ("CLAUSE", "4")
    assert got[4] is None


def test_empty_input(spark):
    assert parse.parse_text(lines(spark, "x").where("false")).count() == 0
    assert clean.formatted(lines(spark, "x").where("false")).count() == 0


def reference_merge(text):
    """Line by line, as the description says."""
    out, taken, rows = [], set(), text.split("\n")
    for i, line in enumerate(rows):
        if i in taken:
            continue
        if line.strip() and line.strip()[:-1].isalnum() and line.strip()[-1] in ".)":
            j = next((k for k in range(i + 1, len(rows)) if rows[k].strip()), None)
            if j is not None:
                taken.add(j)
                line = f"{line.strip()} {rows[j].strip()}"
        out.append(line)
    return out


def test_dangling_markers(spark):
    for text in ("1.\n\nText", "1.\n2.\nText\n3.\n4.\n5.\nend", "a)\nb)\n\nc)", "x\n1."):
        got = [r.line for r in clean.merge_dangling(lines(spark, text)).orderBy("idx").collect()]
        assert got == reference_merge(text)


def test_format(spark):
    text = "  Điều 26. Quyền\n1. Được\n\n\n2. Hưởng  "
    got = clean.formatted(lines(spark, text)).first().text
    assert got == "Điều 26. Quyền\n\n1. Được\n\n2. Hưởng\n"


def test_position_gaps(spark):
    t = spark.createDataFrame([("p", "CLAUSE", 1), ("p", "CLAUSE", 2), ("p", "CLAUSE", 5)], "parent_id string, type string, position int")
    assert [tuple(r) for r in parse.position_gaps(t).collect()] == [("p", "CLAUSE", 2, 5)]


def test_id_collision_raises(spark):
    import pytest

    bad = spark.createDataFrame([("a", 1), ("a", 2)], "id string, x int")
    with pytest.raises(Exception, match="id collision"):
        parse.checked_ids(bad).collect()
    assert parse.checked_ids(bad.where(F.col("x") == 1)).count() == 1


def test_partitions_follow_lines(spark, monkeypatch):
    """Four times the lines take four times the partitions, not larger ones, and a document stays in one to the end."""
    monkeypatch.setattr(parse, "LINES", 300, raising=False)
    text = ["Chương I", "Điều 1. A", "1. x", "a) y", "b) z", "Điều 2. B"]
    for docs in (200, 800):
        lines = spark.createDataFrame([(d, i, t) for d in range(docs) for i, t in enumerate(text)], "doc long, idx long, line string")
        found = parse.parse_text(lines).select("source_doc", "children_count", F.spark_partition_id().alias("p")).collect()
        assert len(found) == 6 * docs and sum(r.children_count for r in found) == 5 * docs
        assert len({(r.source_doc, r.p) for r in found}) == docs
        assert len({r.p for r in found}) == 6 * docs // 300
