import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import cells, chunking, ledger, population, quotes, resolve
from loomwork.sources import files
from loomwork.streaming import rounds
from tests.conftest import SF


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab Cd.!?\n\"1é", max_size=400), st.integers(5, 80), st.integers(0, 40))
def test_chunks_are_slices(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunking.chunks(text, size, overlap)
        return
    spans = chunking.chunks(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans) and [a for a, _ in spans] == sorted({a for a, _ in spans})
    covered = {k for a, b in spans for k in range(a, b)}
    assert all(text[k].isspace() for k in set(range(len(text))) - covered)


def test_sentences():
    of = lambda t: [t[a:b] for a, b in chunking.sentences(t)]
    assert of("Cllr. Jane Doe spoke. She left.") == ["Cllr. Jane Doe spoke.", "She left."]
    assert of("J. R. Smith spoke. 3.5 of 10. yes") == ["J. R. Smith spoke.", "3.5 of 10. yes"]
    assert of('"Stop!" He ran. ') == ['"Stop!"', "He ran."]
    assert [("a b")[a:b] for a, b in chunking.paragraphs("a b")] == ["a b"]


def test_quotes():
    text = "He  said\n“We WILL not\tmove” to all."
    a, b = quotes.find(text, '"we will not move"')
    assert text[a:b] == "We WILL not\tmove"
    assert quotes.find(text, "to all.") is None and quotes.find(text, "we will never move") is None
    assert quotes.find("İ İ something İ said", "something i̇ said") is not None


def test_rounds(spark):
    marks = spark.createDataFrame([(0, 2, 1), (1, 5, None), (2, 5, 4)], "round int, trace_mark long, post_mark long")
    assert [tuple(r) for r in ledger.round_bounds(marks, "post_mark").orderBy("round").collect()] == [(0, 0, 1), (1, 1, 1), (2, 1, 4)]
    rows = spark.range(1, 8).withColumnRenamed("id", "rid")
    got = {r.rid: r.round for r in ledger.attributed(rows, ledger.round_bounds(marks, "trace_mark")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: None, 7: None}
    assert ledger.in_round(rows, ledger.round_bounds(marks, "trace_mark"), 2).count() == 0
    kept = ledger.rolled_back({"t": rows}, marks, 1, {"t": "post_mark"})
    assert kept["t"].count() == 0  # a missing mark clears the table


def test_alias_merge(spark):
    names = ["opposition councillor tom whitfield", "tom whitfield", "whitfield", "councillor tom whitfield", "mill street", "mill street area", "old mill street"]
    rows = spark.createDataFrame([("P", n, n, k, 0) for k, n in enumerate(names)], "type string, normalised string, surface string, chunk int, start int")
    entities = resolve.by_name(rows)
    got = {r.normalised: r.keeper for r in resolve.aliases_merged(entities).collect()}
    assert got == {**{n: n for n in names}, "tom whitfield": names[0], "councillor tom whitfield": names[0], "mill street": "old mill street"}
    folded = {r.keeper: (r.mention_count, r.merged) for r in resolve.folded(entities, resolve.aliases_merged(entities)).collect()}
    assert folded[names[0]] == (3, 3) and len(folded) == 4


def test_inferred_endpoints(spark):
    rel = spark.createDataFrame([("R", "src", "jane doe", 1), ("R", "src", "nobody", 1), ("R", "dst", "acme", 1), ("R", "src", "known", 1)], "relation string, side string, normalised string, chunk int")
    permitted = spark.createDataFrame([("R", "src", ["Person"]), ("R", "dst", ["Org", "Place"])], "relation string, side string, types array<string>")
    chunks = spark.createDataFrame([(1, "Jane Doe and Acme")], "chunk int, text string")
    got = resolve.inferred_endpoints(rel, spark.createDataFrame([("known",)], "normalised string"), permitted, chunks).collect()
    assert [(r.normalised, r.type) for r in got] == [("jane doe", "Person")]


def test_population(spark):
    people = spark.createDataFrame([(k, n) for k, n in enumerate(["Ann Lee", "ann lee", "ANN-LEE", "Bo"])], "user_id long, name string")
    assert [r.username for r in population.usernames(people).orderBy("user_id").collect()] == ["ann_lee", "ann_lee_2", "ann_lee_3", "bo"]
    jobs = spark.createDataFrame([("s", f"j{k}") for k in range(3)] + [("t", "k0")], "sector string, occupation string")
    got = [(r.sector, r.occupation) for r in population.sampled_occupations(jobs, 8).orderBy("place").collect()]
    assert len(got) == 8 and got[:4] == got[4:] and {s for s, _ in got[:2]} == {"s", "t"}
    counts = dict(population.weighted_choice(spark.range(4000), [("a", 0.75), ("b", 0.25), ("c", 0.0)], "id", "x").groupBy("x").count().collect())
    assert set(counts) == {"a", "b"} and abs(counts["a"] - 3000) < 150
    assert population.named_quota(10, 0.05, 3) == 1 and population.named_quota(10, 0.5, 3) == 3 and population.named_quota(10, 0.5, 0) == 0


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"user_id": 1, "name": "A"}, {"user_id": -1}, {"name": "no id"}]))
    assert [r.user_id for r in files.population(spark, str(tmp_path / "p.json")).collect()] == [1]
    (tmp_path / "x.jsonl").write_text('{"index": 1, "name": "old"}\n{"index": 2, "name": "two"}\n{"index": 1, "name": "new"}\n{"index": 3, "na')
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("name", T.StringType())])
    assert sorted(map(tuple, files.partial(spark, str(tmp_path / "x.jsonl"), schema).collect())) == [(1, "new"), (2, "two")]
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, data in {"a.txt": "héllo".encode(), "b.md": "héllo".encode("cp1252"), "c.txt": "hi".encode("utf-16"), "d.txt": b"", "e.exe": b"x"}.items():
        (docs / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in files.documents(spark, str(docs)).collect()}
    assert got == {"a.txt": ("héllo", None), "b.md": ("héllo", None), "c.txt": ("hi", None), "e.exe": (None, "extension")}
    assert files.table_or_empty(spark, str(tmp_path / "none"), schema).count() == 0
    blocks = spark.createDataFrame([(0, 100.0, 0.0, 100.0, 0.0, "title"), (0, 100.0, 55.0, 95.0, 10.0, "right"), (0, 100.0, 0.0, 45.0, 12.0, "left"), (0, 100.0, 0.0, 45.0, 20.0, "left2"), (0, 100.0, 5.0, 99.0, 30.0, "end")], "page int, width double, x0 double, x1 double, y0 double, t string")
    assert [r.t for r in files.ordered_blocks(blocks).orderBy("place").collect()] == ["title", "left", "left2", "right", "end"]
    people = files.population(spark, str(tmp_path / "p.json"))
    files.write_profiles(people, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == 1
    assert {r.problem for r in files.faults(people).collect()} == {"username is blank"}


def test_stream_of_rounds(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    trace = events.select((F.col("event_id") + 1).alias("rid"), "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("action"), F.col("props").alias("info"))
    trace.repartition(3, "user_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trace.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rounds.run_rounds(stream, str(tmp_path / "run"), str(tmp_path / "ck")).awaitTermination()
    led = spark.read.parquet(str(tmp_path / "run/ledger"))
    assert led.count() == 3 and led.agg(F.sum("acted")).first()[0] == trace.count()
    merged = led.select(F.explode("action_counts")).groupBy("key").agg(F.sum("value")).collect()
    assert dict(map(tuple, merged)) == dict(map(tuple, trace.groupBy("action").count().collect()))
    trace.limit(5).write.parquet(str(tmp_path / "run/trace/round=9"))  # a round that was cut off
    assert rounds.rolled_back(spark, str(tmp_path / "run")).count() == trace.count()
    rounds.feed(stream, str(tmp_path / "feed"), str(tmp_path / "ck2"), 50).awaitTermination()
    assert sorted(r.rid for r in spark.read.parquet(str(tmp_path / "feed/batch=2")).collect()) == sorted(r.rid for r in trace.orderBy(F.desc("rid")).limit(50).collect())


def _greedy(rows, least_overlap, least_cosine):
    """As defined, one row after the other."""
    import numpy as np

    out, alive = {}, []
    for kind, name, _, v in sorted(rows, key=lambda r: (r[2], r[1])):
        own, x = set(name.split()), np.array(v) / np.linalg.norm(v)
        for other_kind, other, words, y in alive:
            overlap = 1.0 if own <= words or words <= own else len(own & words) / len(own | words)
            if kind == other_kind and own & words and overlap >= least_overlap and float(x @ y) >= least_cosine:
                out[kind, name] = other
                break
        else:
            alive.append((kind, name, own, x))
            out[kind, name] = name
    return out


def test_similar_merge_in_rounds(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"{rng.choice(['x', 'y', 'x y'])} n{k}", k, [rng.gauss(0, 1) for _ in range(3)] if k % 3 else [1.0, 1.0, 1.0]) for k in range(240)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "type string, normalised string, position long, embedding array<double>").repartition(5)
    monkeypatch.setattr(type(df.groupBy("type")), "applyInPandas", None)  # no type goes to one task
    for members, block in ((2048, 4096), (40, 16)):  # one cell, and several in small blocks
        monkeypatch.setattr(cells, "MEMBERS", members)
        monkeypatch.setattr(cells, "BLOCK", block)
        got = {(r.type, r.normalised): r.keeper for r in resolve.similar_merged(df, 0.3, 0.8).collect()}
        assert got == _greedy(rows, 0.3, 0.8)
    assert resolve.similar_merged(df.limit(0)).collect() == []


def test_alias_merge_without_groups(spark, monkeypatch):
    import random

    rng = random.Random(6)
    names = sorted({" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    rng.shuffle(names)
    rows = spark.createDataFrame([("P", n, n, k, 0) for k, n in enumerate(names)], "type string, normalised string, surface string, chunk int, start int")
    entities = resolve.by_name(rows)
    monkeypatch.setattr(type(entities.groupBy("type")), "applyInPandas", None)
    alive, want = [], {}
    for n in sorted(names, key=lambda n: (-len(n.split()), names.index(n))):
        want[n] = next((s for s in alive if s.endswith(" " + n)), n) if " " in n else n
        if want[n] == n:
            alive.append(n)
    assert {r.normalised: r.keeper for r in resolve.aliases_merged(entities).collect()} == want
