"""Operators whose results SQL can't give, against plain versions and goldens."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as ft
from loomwork.operators import cells, chunking, graph, profiles, search, sentiment
from loomwork.plans import knowledge, registry  # noqa: F401
from loomwork.sources import files, shared
from loomwork.streaming import rounds


def test_nearest_in_cells(spark, monkeypatch):
    """Cells that queries visit give what one block of queries gives, with ties, zeros and nulls."""
    monkeypatch.setattr(cells, "MEMBERS", 20)
    monkeypatch.setattr(cells, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(150)] + [(200, [0.0] * 4), (201, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = v.where("id % 7 = 0 or id >= 200")
    one, many = (sorted((r.query_id, r.place, r.id) for r in search.nearest(v, asked, 4, block).collect()) for block in (4096, 6))
    assert one == many

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    whole = [r for r in rows if r[1] is not None]
    for i, q in whole:
        if i % 7 == 0 or i >= 200:
            best = sorted(whole, key=lambda r, q=q: (-round(cosine(q, r[1]), 12), r[0]))[:4]
            assert sorted(j for k, _, j in one if k == i) == sorted(r[0] for r in best)
    assert search.nearest(v.limit(0), asked, 4, 6).count() == search.nearest(v, asked.limit(0), 4).count() == 0


def test_cells_are_left_out(spark, monkeypatch):
    """Rows around a few directions: queries visit few of the cells, and find the nearest all the same, with null and repeated ids."""
    monkeypatch.setattr(cells, "MEMBERS", 30)
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(k if k % 9 else None if k % 2 else 5, [c + rng.gauss(0, 0.05) for c in centres[k % 12]]) for k in range(900)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    found, placed = cells.cells_of(v.withColumn("row", F.monotonically_increasing_id()), 900)
    visits = cells.visiting(placed, found, 0.4).select(F.size("visits").alias("n"), F.array_contains("visits", F.col("cell")).alias("home")).collect()
    assert len(found.radii) == 30 and all(r.home for r in visits) and sum(r.n for r in visits) < 900 * 30 / 3
    asked = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(rows[:300])], "id long, vector array<double>")
    one, many = (sorted((r.query_id, r.place, str(r.id), round(r.similarity, 9)) for r in search.nearest(v, asked, 7, block).collect()) for block in (4096, 100))
    assert one == many and len(one) == 2100


def test_neighbourhood(spark, monkeypatch):
    """A chain, whose plan doesn't nest however deep it is followed; and a star, whose edges no task has all of."""
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(40)] + [("hub",)], "uuid string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(39)] + [(None, "n3")], "src string, dst string")
    plans = [graph.neighbours(nodes, edges, "n10", d) for d in (1, 2, 4)]
    assert [p._jdf.queryExecution().optimizedPlan().toString().count("Join") for p in plans] == [0, 0, 0]
    assert {r.uuid: r.distance for r in plans[2].collect()} == {f"n{k}": abs(k - 10) for k in range(6, 15)}
    assert graph.neighbours(nodes, edges, "nobody", 2).count() == 0
    monkeypatch.setattr(graph, "HUB", 500)
    star = spark.range(20_000).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), "id").alias("dst"))
    joins = []
    monkeypatch.setattr(graph, "written", lambda df, name: joins.append(df) or shared.written(df, name))
    found = graph.neighbours(nodes.unionByName(star.select(F.col("dst").alias("uuid"))), star, "leaf7", 2)
    assert found.count() == 20_001 and found.where("distance = 2").count() == 19_999
    parts = star.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(40))).groupBy("part").count().collect()
    assert len(joins) == 4 and len(parts) == 40 and max(r["count"] for r in parts) < 700


def test_markdown_beyond_ascii(spark):
    cases = {
        "# Tïtle ﬁve\n\n> quöte [näme](http://x.y/z) *énd*\n": "Tïtle five\n\nquöte näme énd",
        "a\u0085b\n- item line\n---\nrest": "a\u0085b\nitem line\n\nrest",
        "```\ncode\n```\nÅ kept ① <b>x</b> ![i](u) `c`": "Å kept 1 x c",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ft.normalised_markdown(ft.F.col("t")).alias("out"))
    for r in df.collect():
        assert unicodedata.is_normalized("NFKC", r.out)
        assert r.out.split() == cases[r.t].split(), (r.t, r.out)


def test_sentences_and_samples():
    text = "Dr. Doe met Cllr. Kim at 3.30 p.m. today. They spoke! Did it help? J. Smith said (no.) and left. end"
    found = [text[a:b] for a, b in chunking.sentences(text)]
    assert found == ["Dr. Doe met Cllr. Kim at 3.30 p.m. today.", "They spoke!", "Did it help?", "J. Smith said (no.) and left. end"]
    line = "aaa bbb  cccccccc d"
    assert [line[a:b] for a, b in chunking.cut(line, 0, len(line), 5)] == ["aaa", "bbb", "cccc", "cccc", "d"]
    long = " ".join(f"Sentence number {k} is here." for k in range(400))
    sample = chunking.sample(long, 900, 200, 20)
    parts = sample.split(chunking.ELISION)
    assert len(parts) == 3 and all(len(p) <= 300 and p.endswith(".") for p in parts) and long.startswith(parts[0])
    spans = chunking.chunks(long, 200, 40)
    assert all(b - a <= 200 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(long)
    assert all(x[0] < y[0] <= x[1] + 1 for x, y in zip(spans, spans[1:], strict=False))


def test_indexed_without_one_task(spark):
    rows = spark.createDataFrame([(k * 37 % 1000, "x", k) for k in range(1000)], "a long, user_id string, b long").repartition(9)
    got = profiles.indexed(rows, "a").collect()
    assert all(r.a == r.user_id for r in got) and len(got) == 1000
    assert profiles.indexed(rows.limit(0), "a").count() == 0


def test_names_are_different_and_free(spark):
    first, last = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["Ann", "Bo", "Cy", "Ann"], ["Ray", "Sun"]))
    reserved = spark.createDataFrame([("bo sun",)], "normalised string")
    got = [r.name for r in profiles.allocated_names(first, last, reserved, 8).orderBy("place").collect()]
    assert len(got) == len(set(got)) == 8 and "Bo Sun" not in got and sum(n[-1] == "2" for n in got) == 3


def test_scorer_that_fails_and_strays(spark):
    posts = spark.createDataFrame([(k, "bad" if k == 5 else "ok") for k in range(30)], "post_id long, content string").coalesce(1)

    def scorer(batch):
        if any(t == "bad" for _, t in batch):
            raise RuntimeError("no answer")
        return {i: (i / 10, "neutral") for i, _ in batch} | {99: (0.0, "neutral")}

    got = {r.post_id: r.score for r in sentiment.asked(posts, scorer).collect()}
    assert set(got) == {k for k in range(30) if k <= 10} - {4, 5, 6, 7} or set(got) == set(range(11)) - {4, 5, 6, 7}
    assert got[10] == 1.0 and 11 not in got and 99 not in got


def test_refusals(spark, tmp_path):
    with pytest.raises(files.RunNotReadable):
        files.opened(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="least"):
        files.asked(spark, "SELECT * FROM {t} WHERE a > :least AND b = ':x'", {"t": spark.range(3)})


def test_feed_keeps_the_newest_over_batches(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS rid", "id % 5 AS part")
    rows.repartition(5, "part").write.partitionBy("part").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("rid long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*/")
    rounds.feed(stream, f"file://{tmp_path}/feed", f"file://{tmp_path}/check", most=50).awaitTermination()
    assert sorted(r.rid for r in rounds.latest(spark, f"file://{tmp_path}/feed").collect()) == list(range(950, 1000))
    assert len(list((tmp_path / "feed").iterdir())) == 2


def test_sentences_against_sql(spark):
    """The SQL of the sentences on texts with paragraphs, abbreviations, numbers and marks of all kinds."""
    import duckdb

    texts = [
        "Dr. Who met J. Smith at 3.5 p. m. on No. 12. It was 4. 5 came later!  \"Really?\" she said. (Yes.) So it was.\n\nNext etc.\n \t\nand lower. end",
        "One.Two. Three...four? five! Six “seven.” Eight. Nine", "\n\n  \n", " . . ! a", "No end", "Mr.\n\nX.", "A. B? 12ab. c", "vs. \n\n\nThen. été. Été.", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = chunking.split_sentences(docs).select("doc_id", "index", "start", "end", "text").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLES["fnt7_sentences"]).select("doc_id, index, start, \"end\", text").fetchall())
