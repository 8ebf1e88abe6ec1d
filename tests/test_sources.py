import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import clean, parse
from lexigrove.sources import loaders, sinks
from lexigrove.streaming import ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, paragraphs, numbering=True):
    """A small DOCX: (text, style, numId, ilvl) paragraphs; list 1 has decimals and letters, list 2 Roman numerals."""

    def p(text, style=None, num=None, lvl=None):
        pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
        return f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{text[:3]}</w:t></w:r><w:r><w:t>{text[3:]}</w:t></w:r></w:p>"

    level = lambda i, fmt, text, start=1: f'<w:lvl w:ilvl="{i}"><w:start w:val="{start}"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl>'
    numbers = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7">{level(0, "decimal", "%1.")}{level(1, "lowerLetter", "%2)")}</w:abstractNum><w:abstractNum w:abstractNumId="8">{level(0, "upperRoman", "%1.", 3)}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(p(*x) for x in paragraphs)}</w:body></w:document>")
        if numbering:
            z.writestr("word/numbering.xml", numbers)


def test_docx(spark, tmp_path):
    path = str(tmp_path / "a.docx")
    docx(path, [("Điều 1. Tên",), ("khoản một", "ListParagraph", 1, 0), ("điểm a", None, 1, 1), ("điểm b; c) điểm c", None, 1, 1), ("khoản hai", None, 1, 0), ("điểm lại", None, 1, 1), ("phần", None, 2, 0), ("",)])
    got = loaders.load(spark, path).orderBy("index").collect()
    assert [(r["number"], r["marker"], r["text"]) for r in got] == [(None, None, "Điều 1. Tên"), ("1", None, "khoản một"), (None, "a", "điểm a"), (None, "b", "điểm b;"), (None, "c", "điểm c"), ("2", None, "khoản hai"), (None, "a", "điểm lại"), ("III", None, "phần"), (None, None, "")]
    assert got[1]["word_style"] == "ListParagraph" and got[-1]["is_empty"]
    assert all(r["number"] is None or r["marker"] is None for r in got)
    tree = parse.parse(loaders.load(spark, path)).collect()
    assert [r.marker for r in sorted(tree, key=lambda r: r.start_idx) if r.type == "POINT"] == ["a", "b", "c", "a"]


def test_roman_and_letters(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4, 9, 14, 40, 90, 400, 1994, 3999)], "n int")
    assert [r[0] for r in df.select(loaders.roman(F.col("n"))).collect()] == ["I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX"]
    fmt = lambda f, n: df.limit(1).select(loaders.number_text(F.lit(f), F.lit(n))).first()[0]
    assert (fmt("lowerLetter", 27), fmt("upperLetter", 2), fmt("lowerRoman", 4), fmt("decimal", 12)) == ("a", "B", "iv", "12")


def test_text_and_dispatch(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Điều 1. A\r\n\r\n1. b\n".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff bad\nx")
    got = loaders.load(spark, str(tmp_path / "*.txt"))
    a = got.where("doc like '%a.txt'").orderBy("index").collect()
    assert [r["text"] for r in a] == ["Điều 1. A", "", "1. b"] and [r["is_empty"] for r in a] == [False, True, False]
    assert got.where("doc like '%b.txt'").count() == 2
    with pytest.raises(ValueError):
        loaders.load(spark, "a.pdf")


def test_clean_files(spark, tmp_path):
    docx(str(tmp_path / "a.docx"), [("Điều 1. Tên",), ("Trang 1/2",), ("một", None, 1, 0)])
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = {r.doc.rsplit("/", 1)[-1]: r for r in sinks.clean_files(spark, str(tmp_path / "*.docx"), str(tmp_path / "out")).collect()}
    assert got["a.docx"].status == "ok" and got["broken.docx"].status == "failed"
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "Điều 1. Tên\n\n1. một\n"


def test_json_and_embeddings(spark, tmp_path):
    p = str(tmp_path / "n.json")
    (tmp_path / "n.json").write_text('[{"id": "a", "type": "ARTICLE"}]')
    assert loaders.nodes(spark, p).first().id == "a"
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        loaders.nodes(spark, str(tmp_path / "e.json"))
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "b"}]}')
    n, e = loaders.graph(spark, str(tmp_path / "g.json"))
    assert n.count() == e.count() == 1
    (tmp_path / "x.json").write_text('{"extracted_nodes": [{"node_id": "n", "entities": [{"id": "e", "text": "t", "entity_type": "SUBJECT", "evidence": "v"}], "relations": []}]}')
    assert loaders.extractions(spark, str(tmp_path / "x.json")).first().entities[0].id == "e"
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 3.0])], "node_id string, embedding array<float>")
    v.write.parquet(str(tmp_path / "v"))
    assert loaders.embeddings(spark, str(tmp_path / "v"), 2, 2).count() == 2
    with pytest.raises(ValueError):
        loaders.embeddings(spark, str(tmp_path / "v"), 3)
    (tmp_path / "c.csv").write_text("﻿score,label,split\n0.5,1,train\n0.4,0,test\n", encoding="utf-8")
    assert loaders.calibration_rows(spark, str(tmp_path / "c.csv")).count() == 1


def test_sinks(spark, tmp_path):
    routes = spark.createDataFrame([("a", "REJECT", 0.0, "x"), ("b", "LLM_CANDIDATE", 1.0, "y")], "node_id string, route string, routing_score double, reason string")
    assert sinks.write_routes(routes, str(tmp_path / "r")) == {"total_evaluated": 2, "total_candidates": 1}
    fit = spark.createDataFrame([(0.5, 0.1, 3), (1.0, 0.9, 4)], "threshold double, value double, n long")
    sinks.save_calibrator(fit, str(tmp_path / "c"))
    assert loaders and sinks.load_calibrator(spark, str(tmp_path / "c")).count() == 2
    n = spark.createDataFrame([("a", "L1"), ("b", "L2")], "id string, law_code string")
    sinks.replace_law(n, str(tmp_path / "laws"))
    sinks.replace_law(spark.createDataFrame([("c", "L1")], "id string, law_code string"), str(tmp_path / "laws"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "laws")).collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        sinks.require_schema(n.unionByName(n))


def test_delta(spark):
    node = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    edge = lambda *x: spark.createDataFrame(list(x), "source string, target string, type string")
    d = {"added_nodes": node(("c", 1)), "updated_nodes": node(("a", 2)), "removed_nodes": node(("b", 1)), "added_edges": edge(("a", "c", "X")), "updated_edges": edge(("a", "a", "Y")).limit(0), "removed_edges": edge(("a", "a", "Z")).limit(0)}
    n, e = sinks.apply_delta(node(("a", 1), ("b", 1)), edge(("a", "b", "X")), d)
    assert sorted(map(tuple, n.collect())) == [("a", 2), ("c", 1)] and [tuple(r) for r in e.collect()] == [("a", "c", "X")]
    with pytest.raises(ValueError):
        sinks.apply_delta(node(("a", 1)), edge(("a", "a", "X")), d | {"added_edges": edge(("a", "zz", "X"))})


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 1}\n')
    ingest.follow(spark, str(src), "id string, v int", str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination(60)
    (src / "2.json").write_text('{"id": "a", "v": 2}\n')
    ingest.follow(spark, str(src), "id string, v int", str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/version=1")).select("id", "v").collect())) == [("a", 2), ("b", 1)]


def test_stream_in_buckets(spark, tmp_path):
    src, target = tmp_path / "src", str(tmp_path / "t")
    src.mkdir()
    run = lambda: ingest.follow(spark, str(src), "id string, v int, at int", target, str(tmp_path / "ck"), order="at", buckets=4).awaitTermination(60)
    (src / "1.json").write_text("".join(f'{{"id": "k{i}", "v": {i}, "at": 1}}\n' for i in range(40)))
    run()
    for n in range(2, 6):
        (src / f"{n}.json").write_text(f'{{"id": "k7", "v": {100 * n}, "at": 2}}\n{{"id": "k7", "v": {n}, "at": 1}}\n{{"id": "new{n}", "v": 0, "at": 1}}\n')
        run()
    got = {r.id: r.v for r in ingest.current(spark, target).collect()}
    assert got == {f"k{i}": i for i in range(40)} | {f"new{n}": 0 for n in range(2, 6)} | {"k7": 500}
    assert all(len(v) <= 2 for v in ingest._versions(spark, target).values())


def test_edges_are_replaced_by_key(spark):
    old = spark.createDataFrame([("a", "b", "X", 1, "o"), ("a", "c", "X", 1, "o")], "source string, target string, type string, v int, w string")
    new = spark.createDataFrame([("a", "b", "X", 2, None), ("a", "b", "X", 2, None), ("a", "z", "X", 9, "n")], "source string, target string, type string, v int, u string")
    got = sorted((r.target, r.v, r.w, r.u) for r in sinks.upsert_edges(old, new, spark.createDataFrame([("a",), ("b",), ("c",)], "id string")).collect())
    assert got == [("b", 2, "o", None), ("c", 1, "o", None)]


def test_clean_round(spark, sf):
    got = clean.clean_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(got) == 200 and all(r.text.endswith("\n") and "\n\n\n" not in r.text for r in got)
