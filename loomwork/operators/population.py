"""Populations: sampled, named and compared, the same each time they are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import slug
from loomwork.functions.values import uniform
from loomwork.operators.profiles import indexed
from loomwork.sources.shared import written


def sampled_occupations(occupations: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(place, sector, occupation): sectors in turn, each one's occupations in hashed order, from the start again when all are used."""
    turn = F.row_number().over(Window.partitionBy("sector").orderBy(uniform(F.col("occupation"), seed=seed), "occupation"))
    order = occupations.select("sector", "occupation", turn.alias("turn")).orderBy("turn", uniform(F.col("sector"), seed=seed), "sector").limit(count)
    numbered = written(indexed(order.withColumn("shuffled", uniform(F.col("sector"), seed=seed)), "turn", "shuffled", "sector", index="place").drop("turn", "shuffled"), "occupations")
    total = numbered.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    rows = occupations.sparkSession.range(count).select(F.col("id").alias("n"), F.pmod("id", total).alias("place"))
    return rows.join(numbered, "place").select(F.col("n").alias("place"), "sector", "occupation")


def weighted_choice(rows: DataFrame, options: list[tuple[str, float]], key: str, name: str, seed: int = 0) -> DataFrame:
    """rows with one of the options, by weight and the key's hash. Options without weight are left out, unless all are."""
    if any(w > 0 for _, w in options):
        options = [(o, w) for o, w in options if w > 0]
    else:
        options = [(o, 1.0) for o, _ in options]
    total, below = sum(w for _, w in options), 0.0
    u, out = uniform(F.col(key), seed=seed), F.lit(options[-1][0])
    bounds = []
    for o, w in options:
        below += w / total
        bounds.append((o, below))
    for o, upper in reversed(bounds[:-1]):
        out = F.when(u < upper, o).otherwise(out)
    return rows.withColumn(name, out)


def named_quota(total: int, ratio: float, named: int) -> int:
    """How many of a population are named: a share of the total, one at least if anyone is."""
    return min(named, max(int(total * ratio), 1)) if named else 0


def quota(total: Column, ratio: float, named: Column) -> Column:
    """named_quota of columns."""
    return F.when(named > 0, F.least(named, F.greatest(F.floor(total * ratio), F.lit(1)))).otherwise(0).cast("long")


#: A slug that may be another one's handle: that one, and a number as handles have it.
_NUMBERED = "^(.*)_([1-9][0-9]{0,17})$"


def usernames(people: DataFrame, key: str = "user_id", name: str = "name") -> DataFrame:
    """people with username, as if each took one in the order of key: the name's slug, or the first of slug_2, slug_3 and so on that nobody has. Names without a slug get agent_ and the key.

    The n-th of a slug has the number n, but for numbers that others have taken: slug_k is also the first choice of those whose
    own slug it is. Who was there first is settled for all these handles at once, in rounds until nothing changes. Ranks are
    places in a sort over all people, so a slug that many share is spread, and only its first place is looked up.
    """
    kept = [c for c in people.columns if c != "username"]
    named = people.withColumn("_slug", slug(F.col(name), "")).withColumn("_slug", F.when(F.col("_slug") == "", F.concat_ws("_", F.lit("agent"), F.col(key))).otherwise(F.col("_slug")))
    rows = written(indexed(named, "_slug", key, index="_at"), "handles")
    groups = rows.groupBy("_slug").agg(F.min("_at").alias("_first"), F.min(key).alias("_since"), F.count("*").alias("_many"))
    ranked = rows.join(groups.select("_slug", "_first"), "_slug").withColumn("_rank", F.col("_at") - F.col("_first") + 1).drop("_first", "_at")
    claims = groups.where(F.col("_slug").rlike(_NUMBERED)).select(F.regexp_extract("_slug", _NUMBERED, 1).alias("slug"), F.regexp_extract("_slug", _NUMBERED, 2).cast("long").alias("k"), F.col("_slug").alias("claimant"), F.col("_since").alias("since")).where("k > 1")
    claims = written(claims.join(groups.select(F.col("_slug").alias("slug")), "slug", "left_semi").withColumns({"lost": F.lit(False), "held": F.lit(False)}), "claims")
    if claims.limit(1).isEmpty():
        return ranked.withColumn("username", _handle(F.col("_rank"))).select(*kept, "username")
    times = ranked.join(claims.select(F.col("slug").alias("_slug")).distinct(), "_slug", "left_semi")
    times = written(times.select(F.col("_slug").alias("slug"), F.col("_rank").alias("rank"), F.col(key).alias("at")), "times")
    while True:
        met = _skipped(claims).withColumn("rank", F.col("k") - F.col("skipped")).join(times, ["slug", "rank"], "left")
        # Who would take the number came after the claimant, and passes it over, or came before, and the claimant does.
        later, sooner = (F.coalesce(x, F.lit(False)) for x in (F.col("at") > F.col("since"), F.col("at") < F.col("since")))
        after = written(met.select("slug", "k", "claimant", "since", later.alias("lost"), sooner.alias("held"), ((later != F.col("lost")) | (sooner != F.col("held"))).alias("changed")), "claims")
        claims = after.drop("changed")
        if after.where("changed").limit(1).isEmpty():
            break
    lost = claims.where("lost").select(F.col("slug").alias("_slug"), F.col("k").alias("_number")).unionByName(claims.where("held").select(F.col("claimant").alias("_slug"), F.lit(1).cast("long").alias("_number")))
    lost = written(lost, "lost")
    # What is left of a slug's numbers, in their order, goes to its people in theirs.
    wanted = groups.join(lost.groupBy("_slug").agg(F.count("*").alias("_lost")), "_slug").select("_slug", F.explode(F.sequence(F.lit(1), F.col("_many") + F.col("_lost"))).alias("_number"))
    free = written(indexed(wanted.join(lost, ["_slug", "_number"], "left_anti"), "_slug", "_number", index="_at"), "numbers")
    begins = free.groupBy("_slug").agg(F.min("_at").alias("_first"))
    free = free.join(begins, "_slug").select("_slug", "_number", (F.col("_at") - F.col("_first") + 1).alias("_rank"))
    out = ranked.join(free, ["_slug", "_rank"], "left").withColumn("username", _handle(F.coalesce("_number", "_rank")))
    return out.select(*kept, "username")


def _handle(number: Column) -> Column:
    return F.when(number > 1, F.concat_ws("_", "_slug", number)).otherwise(F.col("_slug"))


def _skipped(claims: DataFrame) -> DataFrame:
    """claims with skipped: how many of the slug's lower numbers others have, 1 among them if its own first choice is lost to another slug's person."""
    below = Window.partitionBy("slug").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    held = claims.where("held").select(F.col("claimant").alias("slug"), F.lit(1).alias("first"))
    return claims.join(held, "slug", "left").withColumn("skipped", F.coalesce(F.sum(F.col("lost").cast("int")).over(below), F.lit(0)) + F.coalesce("first", F.lit(0))).drop("first")


def provenance(people: DataFrame) -> DataFrame:
    return people.agg(F.count("*").alias("total"), F.count_if(F.col("provenance") == "named").alias("named"), F.count_if(F.col("provenance") == "synthetic").alias("synthetic"))


def followers(people: DataFrame, key: str = "user_id") -> DataFrame:
    """people with followers and following, by activity level and hash (bases are fixed values)."""
    base = F.when(F.col("activity_level") == "low", 40).when(F.col("activity_level") == "high", 900).otherwise(180)
    spread = F.floor(uniform(F.col("name"), F.col(key)) * 100) / 100
    out = people.withColumn("followers", (base * (0.5 + spread)).cast("int"))
    return out.withColumn("following", (F.col("followers") * (0.6 + spread * 0.8)).cast("int"))


def replaced(stored: DataFrame, submitted: DataFrame, key: str = "user_id", fixed: tuple[str, ...] = ("provenance",)) -> DataFrame:
    """The submitted people, with what may not change, and named people's names, as stored; those that aren't stored are left out."""
    s = stored.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in {*fixed, "name"}])
    out = submitted.join(s, key)
    own = lambda c: F.col(f"_{c}") if c in fixed else F.when(F.col("_provenance") == "named", F.col("_name")).otherwise(F.col("name")) if c == "name" else F.col(c)
    return out.select(key, *[own(c).alias(c) for c in submitted.columns if c != key])


def changes(before: DataFrame, after: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, change): removed, added or edited, by a full join with null-safe comparison."""
    shared = [c for c in before.columns if c != key and c in after.columns]
    b = before.select(key, F.struct(*shared).alias("b"))
    a = after.select(key, F.struct(*shared).alias("a"))
    change: Column = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "edited")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")


def collisions(people: DataFrame, reserved: DataFrame) -> DataFrame:
    """Synthetic people whose normalised name is reserved."""
    return people.where("provenance = 'synthetic'").join(reserved.select("normalised"), "normalised", "left_semi")
