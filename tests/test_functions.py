import uuid

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as ft
from loomwork.functions import values as fv


def each(spark, rows, make, columns="a string, b string"):
    rows = [r if isinstance(r, tuple) else (r, None) for r in rows]
    return [r.out for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {columns}").select("k", make.alias("out")).orderBy("k").collect()]


@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    """Columns can only be named once there is a session."""
    global A, B
    A, B = F.col("a"), F.col("b")


def test_names(spark):
    same = ["Cllr. Jane Doe", "Councillor Jane Doe", "the Hon Jane Doe, PhD", "Jane  Doe Jr. III", "JANE DOE"]
    assert set(each(spark, same, ft.normalised_name(A))) == {"jane doe"}
    assert each(spark, ["Dr. Mr.", "", "Theodore Roe", "O'Neil"], ft.normalised_name(A)) == ["", "", "theodore roe", "o neil"]
    pairs = [("tom whitfield", "opposition councillor tom whitfield"), ("reyes", "alan reyes"), ("mill street", "mill street conservation area"), ("a b", "a b"), ("", ""), ("x y z", "y z")]
    assert each(spark, pairs, ft.is_alias(A, B)) == [True, False, False, True, False, True]
    assert each(spark, [("a b", "b c"), ("a", "a b"), ("", "a"), ("a b c", "d e")], ft.token_similarity(A, B)) == [pytest.approx(1 / 3), 1.0, 0.0, 0.0]
    assert each(spark, [("jane doe", "Said JANE, a doe-eyed"), ("jane roe", "jane")], ft.grounded_in(A, B)) == [True, False]


def test_identifiers(spark):
    assert each(spark, ["Public Figure", "publicFigure", "works-for", "2nd place", " ", "é", "a" * 80], ft.identifier(A)) == ["PublicFigure", "PublicFigure", "WorksFor", "", "", "", "A" + "a" * 62]
    assert each(spark, ["works-for", "publicFigure"], ft.identifier(A, upper_first=False)) == ["WORKS_FOR", "PUBLIC_FIGURE"]
    assert each(spark, ["  Riverbend Wire!", "--"], ft.slug(A, "wire")) == ["riverbend_wire", "wire"]


def test_references(spark):
    texts = ["see post 12", "Post #12 and post 13", "agent 4", "user 7", "in round 3", "@dawn_mercer", "post_id 5", "the four-storey block", "twenty-one days", "3 of the agents", ""]
    got = [[tuple(r) for r in x] for x in each(spark, texts, ft.references(A))]
    assert got == [[("post", "12")], [("post", "12"), ("post", "13")], [("agent", "4")], [("agent", "7")], [("round", "3")], [("username", "dawn_mercer")], [("post", "5")], [], [], [], []]


def test_texts(spark):
    assert each(spark, ["a\r\nb \t\n\n\n\nc​ d  ", "govern-\nment"], ft.normalised_text(A)) == ["a\nb\n\nc d", "govern-\nment"]
    assert each(spark, ["govern-\nment", "Smith-\nJones"], ft.normalised_text(A, dehyphenate=True)) == ["government", "Smith-\nJones"]
    assert each(spark, ["ﬁn ①", None], ft.nfkc(A)) == ["fin 1", None]
    source = "# Head\n\n```py\ncode\n```\n- item [label](http://x) ![i](y)\n> quote **bold** `x`\n\n| a | b |\n|---|---|\n<b>t</b> https://u.v\n"
    assert each(spark, [source], ft.normalised_markdown(A)) == ["Head\n\nitem label\nquote bold x\n\n a b\n\nt"]
    assert each(spark, ['<a href="x">&\'', "```"], ft.escaped(ft.defanged(A))) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;", "&#x27;&#x27;&#x27;"]


def test_coercion(spark):
    assert each(spark, ["34", "34 years old", "thirty-four", "mid-thirties", "early forties", "late fifties", "sixteen", "7", "120", "old"], fv.age(A)) == [34, 34, 34, 35, 42, 58, 16, None, None, None]
    assert each(spark, ["0.7", "70%", "7", "70", "1.4", "high", "Very Low", "-3", "banana", "7 out of 10"], fv.unit_interval(A)) == [0.7, 0.7, 0.7, 0.7, 1.0, 0.75, 0.1, 0.0, None, 0.7]
    assert each(spark, ["high", "prolific", "lurker", "0.9", "0.1", "banana", None], fv.activity_level(A)) == ["high", "high", "low", "high", "low", "moderate", "moderate"]
    assert each(spark, ["a, b; c and d", " , "], fv.listed(A)) == [["a", "b", "c", "d"], []]


def test_hashes_and_vectors(spark):
    space = uuid.UUID(fv.NAMESPACE)
    for a, b in (("g", "é \U0001f642"), ("x", "")):
        assert each(spark, [(a, b)], fv.derived_uuid(A, B)) == [uuid.uuid5(space, f"{a}|{b}").hex]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in v.select(fv.cosine(A, B)).collect()] == [0.707107, 0.0]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>").select(fv.cosine(A, B)).collect()
