"""What keeps memory and shuffles in bounds changes no result."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as ft
from loomwork.operators import loading, resolve, search


def test_edges_counted_by_name(spark):
    """Names of several types, repeated mentions: as many posts as there are edges, of which none comes twice."""
    rng = random.Random(2)
    nodes = spark.createDataFrame([("g", f"n{k}", f"u{k}-{t}") for k in range(5) for t in range(k + 1)], "graph_id string, normalised string, uuid string")
    mentions = spark.createDataFrame([("g", rng.randrange(30), f"n{rng.randrange(7)}") for _ in range(400)], "graph_id string, post_id long, normalised string")
    edges = loading.about_edges(mentions, nodes)
    assert edges.count() == edges.distinct().count() > 0
    want = {r.uuid: r["count"] for r in edges.groupBy("uuid").count().collect()}
    assert {r.uuid: r.posts for r in loading.about_counts(mentions, nodes.union(nodes)).collect()} == want


def test_similarities_are_taken_in_parts(monkeypatch):
    """No matrix has more than so many rows and columns, and the best are the same."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (500, 4)).astype(float)
    queries, ids = [(k, v) for k, v in enumerate(x[:60].tolist())], list(range(500))
    whole = search._Best(queries, 5)
    whole.add(ids, x.tolist())
    monkeypatch.setattr(search, "AT_ONCE", 16)
    parts, sizes = search._Best(queries, 5), []
    add = parts._add
    monkeypatch.setattr(parts, "_add", lambda first, own, similar: (sizes.append(similar.shape), add(first, own, similar)))
    parts.add(ids, x.tolist())
    assert max(max(s) for s in sizes) == 16
    assert [[(round(s, 9), i) for s, _, i in r] for r in parts.rows] == [[(round(s, 9), i) for s, _, i in r] for r in whole.rows]


def test_ascii_stays_out_of_python(spark, tmp_path):
    texts = ["plain", None, "", "ﬁne é ①", "e\u0301"] * 40
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = [r.t for r in df.select("k", ft.nfkc(F.col("text")).alias("t")).orderBy("k").collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    plan = df.select(ft.nfkc(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "RLIKE" in plan


@pytest.mark.parametrize("parts", [64, 1])
def test_types_are_compared_apart(spark, monkeypatch, parts):
    """Whether types share parts or not, rows go where a loop sends them."""
    monkeypatch.setattr(resolve, "TYPE_PARTS", parts)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8))
    rows = [(rng.choice(["a", "b", "c"]), f"name {k}", int(k), (centres[k % 6] + rng.standard_normal(8) * 0.25).tolist()) for k in range(150)]
    rows = [(str(t), n, p, v) for t, n, p, v in rows] + [(None, "name x", 500, centres[0].tolist()), (None, "name y", 501, centres[0].tolist())]
    alive, want = [], {}
    for t, n, _, v in rows:
        u = np.array(v, np.float32).astype(float)
        u /= np.linalg.norm(u)
        first = next((m for s, m, w in alive if s == t and u @ w >= 0.9), None)
        want[n] = first or n
        if first is None:
            alive.append((t, n, u))
    df = spark.createDataFrame(rows, "type string, normalised string, position long, embedding array<float>")
    assert {r.normalised: r.keeper for r in resolve.similar_merged(df, 0.3, 0.9).collect()} == want
