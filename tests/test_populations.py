import random
import re

import pytest

from loomwork.operators import population, resolve


def in_turn(people):
    """The handles of (key, name), taken one after the other."""
    taken, out = set(), {}
    for key, name in sorted(people):
        slug = re.sub("[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_")[:24] or f"agent_{key}"
        handle, n = slug, 1
        while handle in taken:
            n += 1
            handle = f"{slug}_{n}"
        taken.add(handle)
        out[key] = handle
    return out


@pytest.mark.parametrize("seed", range(4))
def test_handles_as_if_taken_in_turn(spark, seed):
    """Names that are others' numbered handles, over several levels, before and after them."""
    rng = random.Random(seed)
    parts = ["jo", "jo 2", "jo 3", "jo 2 2", "jo 2 3", "jo 4 2", "jo 02", "jo 5", "jo 12", "Ann", "ann-2", "", "!!!", "agent 7", "agent 7 2", "x" * 30, "x" * 24 + " 2"]
    people = [(k, rng.choice(parts if seed else parts[:4])) for k in rng.sample(range(1000), 160)]
    df = spark.createDataFrame(people, "user_id long, name string").repartition(5)
    got = {r.user_id: r.username for r in population.usernames(df).collect()}
    assert got == in_turn(people) and len(set(got.values())) == len(people)


def test_handles_of_a_few(spark):
    for names in (["Jo", "Jo", "Jo 2"], ["Jo 2", "Jo", "Jo"], ["Jo 2", "Jo 2", "Jo", "Jo", "Jo", "Jo 2 2"], ["a"], []):
        people = list(enumerate(names))
        df = spark.createDataFrame(people, "user_id long, name string")
        assert {r.user_id: r.username for r in population.usernames(df).collect()} == in_turn(people)


def test_occupations_in_turn(spark):
    o = spark.createDataFrame([("a", f"a{k}") for k in range(5)] + [("b", "b0"), ("b", "b1")], "sector string, occupation string")
    rows = population.sampled_occupations(o, 17).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(17)) and [r.occupation for r in rows[:7]] == [r.occupation for r in rows[7:14]]
    assert {r.sector for r in rows[:2]} == {"a", "b"} and {r.sector for r in rows[:4]} == {"a", "b"} and len({r.occupation for r in rows[:7]}) == 7


def test_conflicts_are_shown_in_part(spark):
    """An attribute with many values: the first holds, a few are listed, all are rows."""
    values = [("P", "ann", "job", f"v{k % 300}", k) for k in range(900)] + [("P", "bo", "job", "x", 4), ("P", "bo", "job", None, 2)]
    df = spark.createDataFrame(values, "type string, normalised string, key string, value string, chunk long")
    rows = {r.normalised: r for r in resolve.attributes_folded(df).collect()}
    assert (rows["ann"].value, rows["ann"].n_conflicts, len(rows["ann"].conflicts)) == ("v0", 299, resolve.SHOWN)
    assert [tuple(c) for c in rows["ann"].conflicts] == [(f"v{k}", k) for k in range(1, resolve.SHOWN + 1)]
    assert (rows["bo"].value, rows["bo"].n_conflicts) == (None, 1) and [tuple(c) for c in rows["bo"].conflicts] == [("x", 4)]
    assert resolve.attribute_values(df).where("normalised = 'ann'").count() == 300
