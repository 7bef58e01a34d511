import random

import pytest
from pyspark.sql import functions as F

from tests.trees import CASES, evaluate, text_of
from xylem.engine import Documents
from xylem.plans.xpath_ast import XPathSyntaxError, parse_xpath


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = sorted({c[0] for c in CASES})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "doc_id long, content string")
    return {x: i for i, x in enumerate(docs)}, Documents(df).store(str(tmp_path_factory.mktemp("elements") / "e"))


@pytest.mark.parametrize("strategy", ["join", "window"])
def test_cases(stored, strategy):
    ids, docs = stored
    wrong = []
    for xml, path, expected in CASES:
        found = docs.xpath(path, strategy).where(F.col("doc_id") == ids[xml]).orderBy("match_no").collect()
        got = len(found) if isinstance(expected, int) else [r["text"] for r in found]
        if got != expected or len(evaluate(xml, path)) != len(found):
            wrong.append((path, got, expected))
    assert not wrong


def random_tree(rng, depth=0):
    name = rng.choice("abc")
    attrs = "".join(f' {k}="{rng.randint(0, 3)}"' for k in "xy" if rng.random() < 0.4)
    if depth > 3 or rng.random() < 0.25:
        kind = rng.random()
        body = str(rng.randint(0, 4)) if kind < 0.5 else "<![CDATA[<é&>]]>" if kind < 0.7 else None
        return f"<{name}{attrs}/>" if body is None else f"<{name}{attrs}>{body}</{name}>"
    return f"<{name}{attrs}>" + "".join(random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))) + f"</{name}>"


PATHS = ["/a/b", "/a/b/c", "/b/a[@x='1']/c", "/a/a[b=2]", "/c/b[0]/a", "/a/c[1]/b[c>1]", "/b/c[last()]/a", "/c/a[position()>1]/b", "/a[@y='2']/b", "/a[b>=3]/b"]


def test_random_trees(spark):
    rng = random.Random(5)
    docs = [random_tree(rng) for _ in range(120)]
    df = Documents(spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string"))
    df = Documents(df.df, stored=df.elements().cache())
    for path in PATHS:
        want = sorted((i, k, text_of(n)) for i, x in enumerate(docs) for k, n in enumerate(evaluate(x, path), 1) if text_of(n) is not None and "<" not in text_of(n))
        for strategy in ("join", "window"):
            rows = df.xpath(path, strategy).collect()
            assert len(rows) == sum(len(evaluate(x, path)) for x in docs), (path, strategy)
            leaves = {(r["doc_id"], r["match_no"]): r["text"] or "" for r in rows}
            assert all(leaves[i, k] == t for i, k, t in want), (path, strategy)


@pytest.mark.parametrize("path", ["", "/", "/a//b", "/a[b", "/a[=1]", "/a[@x=1]", "/a/[b=1]", "/a[@zone=1south']", "/a b", "/a[0][1]", "/a[text()]"])
def test_syntax_errors(path):
    with pytest.raises(XPathSyntaxError):
        parse_xpath(path)


def test_slashes_and_values():
    assert parse_xpath("a/b/") == parse_xpath("/a/b")
    assert parse_xpath("/a[@p='x/y]']/b")[0].predicate.value == "x/y]"


def test_offsets_and_raw(spark):
    xml = '<ü a="é"><b>x</b><c/>tail</ü>'
    raw = xml.encode()
    docs = Documents(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, content binary"))
    rows = {r["name"]: r for r in docs.elements().collect()}
    assert {n: raw[r["start_off"] : r["end_off"]].decode() for n, r in rows.items()} == {"ü": xml, "b": "<b>x</b>", "c": "<c/>"}
    assert rows["ü"]["attrs"] == {"a": "é"} and rows["c"]["self_closing"] and rows["b"]["parent_id"] == 0
    assert docs.preview("/ü") == ["<b>x</b><c/>tail"] and docs.preview("/ü/c") == ["<c/>"] and docs.count("/ü/b") == 1


def test_affix_and_entities(spark):
    docs = Documents(spark.createDataFrame([(1, '<r><i k="ab&amp;c"><v>x185</v></i></r>')], "doc_id long, content string"))
    assert docs.xpath("/r/i[@k='ab']", affix_compat=True).count() == 1 and docs.xpath("/r/i[@k='ab']").count() == 0
    assert docs.xpath("/r/i[v=185]", affix_compat=True).count() == 1 and docs.xpath("/r/i[v=185]").count() == 0
    text = Documents(spark.createDataFrame([(1, "<r>&lt;&amp;lt;</r>")], "doc_id long, content string"))
    assert text.xpath("/r", entities=True).first()["text"] == "<&lt;"


def test_repeated_attributes(spark):
    docs = Documents(spark.createDataFrame([(1, '<r a="1" b=\'2\' a="3"/>'), (2, "<r/>"), (3, '<r x = "a=b"/>')], "doc_id long, content string"))
    assert {r["doc_id"]: r["attrs"] for r in docs.elements().collect()} == {1: {"a": "3", "b": "2"}, 2: {}, 3: {"x": "a=b"}}
