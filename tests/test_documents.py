import os

import pytest
from pyspark.sql import functions as F

from tests.trees import BAD, GOOD, RIVER
from xylem.engine import Documents, Engine
from xylem.operators.validate import MalformedXmlError
from xylem.sources import large, sinks
from xylem.sources.documents import expectations, typed_rows
from xylem.sources.large import large_path
from xylem.streaming.stream import stream_matches


def test_verdicts(spark):
    docs = [(x, False) for x in BAD] + [(x, True) for x in GOOD]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(docs)], "doc_id long, content string")
    got = {r["doc_id"]: r["status"] for r in Documents(df).verdicts().collect()}
    assert [docs[i] for i, s in got.items() if (s == "ok") != docs[i][1]] == []


def test_odd_documents(spark):
    df = spark.createDataFrame([(1, bytearray(b"plain")), (2, bytearray(b"")), (3, None), (4, bytearray(b"<a>\xc3(</a>")), (5, bytearray(b"<a/>"))], "doc_id long, content binary")
    docs = Documents(df)
    assert {r["doc_id"]: r["status"] for r in docs.verdicts().collect()} == {1: "no_tokens", 2: "no_tokens", 3: "malformed", 4: "malformed", 5: "ok"}
    assert [r["doc_id"] for r in docs.valid().xpath("/a").collect()] == [5]
    with pytest.raises(MalformedXmlError):
        docs.valid(strict=True)
    empty = Documents(df.limit(0))
    assert empty.elements().count() == 0 and empty.verdicts().count() == 0


def test_skip_misc(spark):
    xml = '<?xml version="1.0"?><!DOCTYPE r><r><!-- <x> --><a>1</a></r>'
    df = spark.createDataFrame([(1, xml)], "doc_id long, content string")
    assert Documents(df).valid().count("/r/a") == 0
    docs = Documents(df, skip_misc=True)
    assert docs.valid(strict=True).xpath("/r/a").first()["start_off"] == xml.index("<a>")


def test_tokens(spark):
    xml = '<a k="1"><b/><![CDATA[<x y="2"/>]]></a>'
    df = spark.createDataFrame([(1, xml)], "doc_id long, content string")
    rows = [(r["off"], r["tok"], r["depth"]) for r in Documents(df).tokens().orderBy("off").collect()]
    assert rows == [(0, "<", 0), (4, "=", 1), (9, "<", 1), (11, "/", 1), (xml.index("</a") + 1, "/", 0)]
    s = Documents(df).stats().first()
    assert (s["n_bytes"], s["n_tokens"], s["max_depth"], s["has_cdata"]) == (len(xml), 5, 1, True)


def test_files_cli_and_stream(spark, tmp_path, capsys):
    from xylem.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(RIVER)
    assert Engine(spark).load(str(tmp_path / "in")).count("/river/gauge") == 6
    assert main([str(tmp_path / "in" / "a.xml"), "/river/gauge[@bank='left']/level"]) == 0
    assert capsys.readouterr().out.splitlines() == ["Matches found: 3", "Match 1: <![CDATA[7]]>", "Match 2: <![CDATA[21]]>", "Match 3: <![CDATA[35]]>"]
    assert main([str(tmp_path / "in" / "a.xml"), "/river//level"]) == 2
    (tmp_path / "bad.xml").write_text("<a>")
    assert main([str(tmp_path / "bad.xml"), "/a"]) == 1
    spark.createDataFrame([(1, RIVER), (2, "<x>")], "doc_id long, content string").write.parquet(str(tmp_path / "s"))
    got = []
    q = stream_matches(spark.readStream.schema("doc_id long, content string").parquet(str(tmp_path / "s")), "/river/gauge/dry", lambda df, n: got.extend(r["raw"] for r in df.collect()), str(tmp_path / "c"), availableNow=True)
    q.awaitTermination()
    assert got == ["<dry/>", "<dry/>"]


def test_large_file_in_splits(spark, tmp_path):
    items = "".join(f'<item no="{i}"><qty>{i}</qty><note><![CDATA[<qty>0</qty></x>]]></note></item>' for i in range(3000))
    (tmp_path / "big.xml").write_text(f"<order>é{items}</order>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = large_path(spark, str(tmp_path / "big.xml"), "/order/item/qty").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    data = (tmp_path / "big.xml").read_bytes()
    assert sorted(int(r["text"]) for r in rows) == list(range(3000))
    assert all(data[r["start_off"] :].startswith(f"<qty>{r['text']}<".encode()) for r in rows)


def test_sinks_and_typed_rows(spark, tmp_path):
    m = spark.createDataFrame([("a", "r1", 1.0), ("a", "r2", 2.0), ("b", "r1", 3.0)], "metric string, run string, value double")
    assert {r["metric"]: (r["r1"], r["r2"]) for r in sinks.metrics_table(m).collect()} == {"a": ("1.0", "2.0"), "b": ("3.0", "NA")}
    sinks.write_report(m, str(tmp_path / "csv"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "csv"))
    (tmp_path / "t.xml").write_text(RIVER)
    assert typed_rows(spark, str(tmp_path / "t.xml"), "gauge").count() == 6
    (tmp_path / "m.json").write_text('[{"filename": "f", "query": "/a", "type": "count", "expected": "1"}]')
    assert expectations(spark, str(tmp_path / "m.json")).first()["expected"] == "1"


def test_timings(spark):
    t = Documents(spark.createDataFrame([(1, RIVER)], "doc_id long, content string")).timings("/river/gauge")
    assert set(t) == {"validation", "tokenization", "structure", "query"}


def test_malformed_kinds_reads_all_orders(spark, sf, monkeypatch):
    from xylem import corpora, queries
    from xylem.operators import validate

    seen = []
    plain = validate.errors
    monkeypatch.setattr(validate, "errors", lambda docs, *a: seen.append(docs) or plain(docs, *a))
    queries.malformed_kinds(spark, sf)
    orders = corpora.orders_xml(spark, sf)
    assert seen[0].count() == orders.count()
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("C328")))).when(F.col("doc_id") % 11 == 1, F.encode(F.concat("content", F.lit("<z")), "UTF-8")).otherwise(F.encode("content", "UTF-8"))
    got = {(r["doc_id"] % 11, r["kind"]) for r in plain(orders.withColumn("content", content)).collect()}
    assert got == {(0, "utf8"), (1, "unterminated")}


def test_large_file_cdata_text(spark, tmp_path):
    notes = ["a<![CDATA[b]]>c", "<![CDATA[<x>é</y> <]]>", "plain", "<![CDATA[]]>", "p<![CDATA[q]]><![CDATA[<r]]>s" * 40]
    x = "<o>" + "".join(f"<i><k>{j}</k><t at='{j}'>{notes[j % 5]}</t></i><i><t/></i>" for j in range(400)) + "</o>"
    (tmp_path / "big.xml").write_text(x)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {r["start_off"]: r["text"] for r in large_path(spark, str(tmp_path / "big.xml"), "/o/i/t").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    small = Documents(spark.createDataFrame([(1, x)], "doc_id long, content string")).xpath("/o/i/t").collect()
    assert got == {r["start_off"]: r["text"] for r in small} and len(got) == 800


LARGE_PATHS = [
    "/r/g[@k='2']/i/t", "/r/g/i[@k!='3']/t", "/r/g[k<3]/i/t", "/r/g/i[t=5]/t", "/r/g/i[1]/t", "/r/g[0]/i[1]/t", "/r/g[last()]/i[last() - 1]/t",
    "/r/g/i[position()>2]", "/r/g[@k>='2']/i[t!=4]/t", "/r/g[k=1]/i[t='x y']/t", "/r[0]/g[last() - 1]/i", "/r/g/i/t[0]", "/r[@k='none']/g", "/r/g/i[m=1]",
]


def test_large_file_predicates(spark, tmp_path):
    inner = lambda g, j: f"<i k='{j}'><t>{(g + j) % 7}</t></i><o/>" if j % 3 else f"<i k=\"{j}\"><t><![CDATA[x y]]></t><t/><m>1<n/></m></i>"
    groups = "".join(f"<g k='{g % 4}'><k>{g % 5}</k>{''.join(inner(g, j) for j in range(g % 6))}</g><i/>" for g in range(60))
    x = f"<r>{groups}</r><r k='none'><g/></r>"
    (tmp_path / "big.xml").write_text(x)
    small = Documents(spark.createDataFrame([(1, x)], "doc_id long, content string"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for path in LARGE_PATHS:
            got = sorted(r["start_off"] for r in large_path(spark, str(tmp_path / "big.xml"), path).collect())
            assert got == sorted(r["start_off"] for r in small.xpath(path).collect()), path
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


CHUNK_PATHS = ["/r/g/i/t", "/r/g[k=5]/i[last() - 1]/t", "/r[k!=4]/g[@q=\"a>'b\"]/i[0]/t"]


def test_large_file_in_chunks(spark, tmp_path, monkeypatch):
    """Chunks of any size give the same hits and texts, whatever goes on over their ends; no text is shuffled."""
    notes = ["a<![CDATA[b<c></d>]]>z", "5", "<![CDATA[5]]>", "x ]]> y", "<![CDATA[" + "<p/>" * 60 + "]]>5"]
    item = lambda g, j: f"<i><t>{notes[(g * 3 + j) % 5]}</t><k/></i>\n"
    x = f"<r><k>{notes[4]}</k>" + "".join(f"<g q=\"a>'b\">{''.join(item(g, j) for j in range(g % 5))}<k>{notes[g % 5]}</k></g>" for g in range(25)) + "</r>"
    (tmp_path / "big.xml").write_text(x)
    small = Documents(spark.createDataFrame([(1, x)], "doc_id long, content string"))
    for size, path in zip((100, 400, 150), CHUNK_PATHS, strict=True):
        monkeypatch.setattr(large, "CHUNK", size)
        found = large_path(spark, str(tmp_path / "big.xml"), path)
        got = sorted((r["start_off"], r["text"]) for r in found.collect())
        assert got == sorted((r["start_off"], r["text"]) for r in small.xpath(path).collect()) and got, path
    monkeypatch.setattr(large, "CHUNK", 1 << 20)
    plan = large_path(spark, str(tmp_path / "big.xml"), "/r/g/i[1]/t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_comparison_of_bytes_is_that_of_columns(spark):
    from xylem.functions.text import compare, comparison

    texts = ["1", " 2 ", "2d", "1e3", "NaN", "-inf", "+Infinity", "0x1.8p1", "abc", "", "1_0", ".5", "5.", "1e400", "1e", "0x10", "1 2", "é", "9", "10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    asked = [(op, v) for op in ("=", "!=", "<", ">", "<=", ">=") for v in ("2", "abc", "nan", "10")]
    for r in df.select("t", *[compare(F.col("t"), op, v).alias(f"c{i}") for i, (op, v) in enumerate(asked)]).collect():
        assert [r[f"c{i}"] for i in range(len(asked))] == [comparison(op, v)(r["t"].encode()) for op, v in asked], r["t"]


def test_raw_of_many_matches_meets_a_document_once(spark):
    x = "<r>é" + "".join(f"<g k='{g}'><v>{g}é</v></g>" for g in range(50)) + "</r>"
    df = spark.createDataFrame([(1, x), (2, "<r><g>7</g><g/></r>")], "doc_id long, content string")
    found = Documents(df, unique_ids=True).xpath("/r/g", raw=True)
    got = {(r["doc_id"], r["match_no"]): r["raw"] for r in found.collect()}
    assert got == {(1, g + 1): f"<v>{g}é</v>" for g in range(50)} | {(2, 1): "7", (2, 2): "<g/>"}
    binary = Documents(df.withColumn("content", F.encode("content", "UTF-8")), unique_ids=True).xpath("/r/g", raw=True)
    assert {(r["doc_id"], r["match_no"]): r["raw"] for r in binary.collect()} == got
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_large_document_in_parts(spark, tmp_path):
    import gzip

    section = lambda g: f"<k><![CDATA[<x>{g} </g>]]> y</k>" if g % 4 == 0 else f"<k>{g % 5}</k>"
    items = lambda g: "".join(f"<i k='{j}'><t>{(g + j) % 7}</t></i>\n<o/>" for j in range(g % 6))
    x = f"<r>{''.join(f'<g k=\'{g % 4}\'>{section(g)}{items(g)}</g><i/>' for g in range(40))}</r><r k='none'><g/></r>\n"
    small = Documents(spark.createDataFrame([(1, x)], "doc_id long, content string"))
    tags = [k for k, c in enumerate(x) if c == "<"]
    for step in (37, 5):
        cuts = [0, *tags[step::step], len(x)]
        top = tmp_path / f"parts-{step}"
        top.mkdir()
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            (top / f"part-{n:05}.xml.gz").write_bytes(gzip.compress(x[a:b].encode())) if n % 2 else (top / f"part-{n:05}.xml").write_text(x[a:b])
        for path in ["/r/g/k", "/r/g[k='<x>8 </g> y']/i/t", "/r/g[k<3]/i[last() - 1]/t", "/r[@k='none']/g"]:
            found = large_path(spark, str(top), path, in_parts=True)
            assert {r["start_off"]: r["text"] for r in found.collect()} == {r["start_off"]: r["text"] for r in small.xpath(path).collect()}, (path, step)
    (top / "part-99999.xml").write_text("text <g/>")
    with pytest.raises(ValueError, match="begin at a tag"):
        large_path(spark, str(top), "/r/g", in_parts=True)


def test_large_orders_are_written_by_many_tasks(spark, sf, monkeypatch):
    from xylem import queries

    monkeypatch.setattr(queries, "PART_ORDERS", 40)
    path = queries._large_orders(spark, sf)
    assert spark.read.format("binaryFile").load(path).count() > 1
    got = large_path(spark, path, "/order/item/qty", in_parts=True)
    assert got.count() == queries.corpora.read(spark, sf, "lineitem").count()


def test_known_length_saves_the_count_of_packed_parts(spark, tmp_path, monkeypatch):
    import gzip

    rows = [f"<g k='{g}'><t>{g}</t></g>\n" for g in range(30)]
    for n in range(3):
        (tmp_path / f"part-{n}.xml.gz").write_bytes(gzip.compress("".join(rows[n * 10 : n * 10 + 10]).encode()))
    (tmp_path / "part-3.xml.gz").write_bytes(gzip.compress(b""))
    small = Documents(spark.createDataFrame([(1, "".join(rows))], "doc_id long, content string"))
    wanted = {r["start_off"]: r["text"] for r in small.xpath("/g/t").collect()}
    read, plain, n = [], large.records, len("".join(rows))
    monkeypatch.setattr(large, "records", lambda spark, path, end: read.append(end) or plain(spark, path, end))
    assert {r["start_off"]: r["text"] for r in large_path(spark, str(tmp_path), "/g/t", in_parts=True, length=n).collect()} == wanted
    assert read == ["\n<"]
    assert {r["start_off"]: r["text"] for r in large_path(spark, str(tmp_path), "/g/t", in_parts=True, length=n + 1).collect()} == wanted
    monkeypatch.setattr(large, "LONGEST", 20)  # rows over it are left out, until rows end at each `<`
    assert {r["start_off"]: r["text"] for r in large_path(spark, str(tmp_path), "/g/t", in_parts=True, length=n).collect()} == wanted
    assert read[-1] == "<"


def _tags(x: str):
    import numpy as np

    return large._Tags((1, 0, 0), np.frombuffer(x.encode() + b"<", np.uint8), 8)


def test_attributes_of_many_tags_at_once(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(3)
    bits = ['k="1"', 'k="2"', "k='1'", 'k = "1"', 'k="a=b"', 'k=""', 'xk="1"', 'q="k"', '"k"', 'k="<', '="1"', 'q="1>2"', "é='k'", 'é="1"', 'k="é"', "k=", '"', "'", "/", " "]
    odd = _tags("".join(f"<{rng.choice(['a', 'k'])} {rng.choice([' ', '', chr(10)]).join(rng.choices(bits, k=rng.randrange(5)))}{rng.choice(['>', '/>', '', '>x=k'])}" for _ in range(3000)))
    rows = np.flatnonzero(~odd.close)
    for name, op, value in [("k", "=", "1"), ("k", "!=", "1"), ("k", "<", "2"), ("é", "=", "1"), ("q", "=", "k")]:
        p, ok = large.Attribute(name, op, value), large.comparison(op, value)
        got = odd.attributes(rows, p, ok)
        assert got.tolist() == [odd.attribute(r, p, ok) for r in rows.tolist()] and (name == "é" or got.any()), p
    many = _tags("".join(f'<a n="{j}" k="{j % 3}"/>' for j in range(99)))
    monkeypatch.setattr(large._Tags, "attribute", None)  # plain tags do not need it
    assert many.attributes(np.arange(99), large.Attribute("k", "=", "2"), None).sum() == 33


def test_no_scan_for_what_crosses_where_nothing_does(spark, tmp_path, monkeypatch):
    x = "".join(f"<g><k>{g % 5}</k><i>{g}</i><k><![CDATA[3]]></k></g>\n" for g in range(200))
    (tmp_path / "big.xml").write_text(x)
    small = Documents(spark.createDataFrame([(1, x)], "doc_id long, content string"))
    asked, plain = [], large.shared_path
    monkeypatch.setattr(large, "shared_path", lambda spark, name: asked.append(name) or plain(spark, name))
    for path in ("/g[k=2]/i", "/g[k!=3]/i", "/g[k>2]/i"):
        got = [r["start_off"] for r in large_path(spark, str(tmp_path / "big.xml"), path).collect()]
        assert sorted(got) == sorted(r["start_off"] for r in small.xpath(path).collect()) and got, path
    assert not asked
    monkeypatch.setattr(large, "CHUNK", 500)  # rows end before `<g>`: still nothing crosses
    assert large_path(spark, str(tmp_path / "big.xml"), "/g[k=2]/i").count() == 40 and not asked
    (tmp_path / "open.xml").write_text(f"<r>{x}</r>")
    assert large_path(spark, str(tmp_path / "open.xml"), "/r[k=2]/g").count() == 0 and asked == ["crossing"]
    (tmp_path / "end.xml").write_text("<g><k>2</k>")  # open at the end
    assert large_path(spark, str(tmp_path / "end.xml"), "/g[k=2]").count() == 1


def test_texts_of_plain_tags_are_cut_from_the_arrays(spark, tmp_path):
    texts = ["4 ]]> ", "", "a>b", "x y", "1 ]]>]]>"]
    x = "".join(f"<g><t a='>'>{texts[j % 5]}</t><t/></g>\n" for j in range(50))
    tags = _tags(x)
    path = large._Path(large.parse_xpath("/g/t"))
    known = large._Known(begins={(1, 0, 0): large._Begin(0, 0, False, (None, None), {}, None)})
    hits = large._Chunk(tags, path, (1, 0, 0), known).hits().to_pylist()
    assert [h["text"] for h in hits if not h["empty"]] == [texts[j % 5] for j in range(50)] and not any(h["data"] for h in hits)
    for n, odd in enumerate(["<g><t>é</t><t>u</t></g>", "<g><t b=\"<![CDATA[x]]>\">y</t></g>", "<g><t>a<![CDATA[<t>]]>b</t><t b='\">' c='>'>z</t></g>", "<g><t>&lt;<![CDATA[q]]></t></g>"]):
        (tmp_path / f"{n}.xml").write_text(x + odd)
        small = Documents(spark.createDataFrame([(1, x + odd)], "doc_id long, content string"))
        got = {r["start_off"]: r["text"] for r in large_path(spark, str(tmp_path / f"{n}.xml"), "/g/t").collect()}
        assert got == {r["start_off"]: r["text"] for r in small.xpath("/g/t").collect()}, odd
