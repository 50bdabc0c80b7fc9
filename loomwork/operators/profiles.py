"""Profiles of agents: fields as models write them, what is shown of them, names and numbers."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.text import normalised_name
from loomwork.sources.shared import written

#: Other names of fields, in the order in which they are looked for (fixed values).
FIELD_ALIASES = {
    "bio": "background", "biography": "background", "summary": "background", "job": "occupation", "profession": "occupation", "role": "occupation", "job_title": "occupation",
    "personality_traits": "traits", "characteristics": "traits", "big_five": "personality", "big5": "personality", "political_leaning": "leanings", "political_leanings": "leanings",
    "leaning": "leanings", "stance": "leanings", "activity": "activity_level", "posting_frequency": "activity_level", "style": "writing_style", "writing_style_hint": "writing_style",
    "tone": "writing_style", "hobbies": "interests",
}
SEARCHED = ("name", "username", "occupation", "sector", "leanings", "background", "interests", "traits")
ALWAYS_ELIGIBLE = "Person"


def field(record: Column, name: str) -> Column:
    """A field of a JSON record under its own name, or else under the first of its other names that is there."""
    return F.coalesce(*[F.get_json_object(record, f"$.{n}") for n in [name, *[a for a, own in FIELD_ALIASES.items() if own == name]]])


def sector(occupation: Column, sectors: dict[str, list[str]]) -> Column:
    """The first sector of which some occupation is in the text; other if there is none."""
    text, out = F.lower(F.trim(occupation)), F.lit("other")
    for name, words in reversed(list(sectors.items())):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w))
        out = F.when(found, name).otherwise(out)
    return out


def with_provenance(people: DataFrame, wanted: str | None) -> DataFrame:
    """People who are named, or synthetic; any other word filters nothing."""
    return people.where(F.col("provenance") == wanted) if wanted in ("named", "synthetic") else people


def matching(people: DataFrame, needle: str) -> DataFrame:
    """People with the needle, in lower case, in any of the searched fields; lists count by their items. A blank needle keeps all."""
    needle = needle.strip().lower()
    kinds = dict(people.dtypes)
    texts = [F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c) for c in SEARCHED if c in kinds]
    return people.where(F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(needle))) if needle else people


def eligible(entities: DataFrame, individuals: list[str], institutions: list[str] | None = None) -> DataFrame:
    """Entities that may become agents: of individual types and of Person, and of institutional ones if these are given; the most mentioned first, then by name."""
    return entities.where(F.col("type").isin(sorted({*individuals, *(institutions or []), ALWAYS_ELIGIBLE}))).orderBy(F.desc("mention_count"), "name", "uuid")


def persona(p: DataFrame) -> Column:
    """A profile as a line of labelled parts; those without content are left out."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    parts = [
        F.concat(F.concat_ws(", ", "name", F.col("age").cast("string"), "occupation"), F.lit(".")), some("background"), F.concat(F.lit("Traits: "), listed("traits"), F.lit(".")), F.concat(F.lit("Interests: "), listed("interests"), F.lit(".")),
        F.concat(F.lit("Stance: "), some("leanings"), F.lit(".")), F.concat(F.lit("Style: "), some("writing_style"), F.lit(".")), F.concat(F.lit("Activity: "), F.col("activity_level"), F.lit(".")),
    ]
    return F.concat_ws(" ", *parts)


def twitter_rows(people: DataFrame) -> DataFrame:
    """Profiles (user_id, username, ...) in the columns of the microblog's import."""
    about = F.coalesce(F.nullif(F.trim("background"), F.lit("")), "occupation")
    return people.select("user_id", "name", "username", about.alias("description"), persona(people).alias("user_char"), F.lit("[]").alias("following_agentid_list"), "provenance", "activity_level")


def reddit_rows(people: DataFrame, default_country: str) -> DataFrame:
    """Profiles in the fields of the forum's import; what isn't known of a person is unstated, the country the default."""
    about = F.coalesce(F.nullif(F.trim("background"), F.lit("")), "occupation")
    return people.select("user_id", "username", "name", about.alias("bio"), persona(people).alias("persona"), F.coalesce("gender", F.lit("unstated")).alias("gender"), "age", F.coalesce("country", F.lit(default_country)).alias("country"), "provenance")


def indexed(rows: DataFrame, *order: Column | str, index: str = "user_id") -> DataFrame:
    """rows with a dense index from 0 in the given order, which must tell all rows apart.

    A sort over all partitions, written once; the counts of the partitions, a row for each, give where each one begins. No task holds all rows.
    """
    kept = written(rows.drop(index).orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "indexed")
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = counts.agg(F.array_sort(F.collect_list(F.struct("_part", "n")))).scalar()
    begin = F.aggregate(F.filter(F.col("_counts"), lambda c: c["_part"] < part), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return kept.withColumn("_counts", before).withColumn(index, begin + place).drop("_row", "_counts")


def allocated_names(first: DataFrame, last: DataFrame, reserved: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(place, name) for so many people: different names of a first name and a surname (name), none of which is reserved (normalised).

    Person i takes the pair that a step coprime to the number of pairs leads to, so none comes twice before all have; then
    they come again with 2, 3 and so on behind them. Reserved names are passed over.
    """
    a, b = (written(indexed(names.select("name").distinct(), "name", index="at"), "names") for names in (first, last))
    n, m = a.count(), b.count()
    pairs = max(n * m, 1)
    step = next(s for s in range(7919 + 2 * seed, 7919 + 2 * seed + 4 * pairs + 4) if gcd(s, pairs) == 1)
    rows = first.sparkSession.range(count + reserved.count()).select("id", F.pmod(F.col("id") * step + seed, F.lit(pairs)).alias("pair"), F.expr(f"id div {pairs} + 1").alias("turn"))
    rows = rows.join(a.select(F.col("at").alias("i"), F.col("name").alias("given")), F.pmod("pair", F.lit(max(n, 1))) == F.col("i")).join(b.select(F.col("at").alias("j"), F.col("name").alias("family")), F.expr(f"pair div {max(n, 1)}") == F.col("j"))
    named = rows.select("id", F.concat_ws(" ", "given", "family", F.when(F.col("turn") > 1, F.col("turn").cast("string"))).alias("name"))
    free = named.withColumn("normalised", normalised_name(F.col("name"))).join(reserved.select("normalised"), "normalised", "left_anti")
    return indexed(free.orderBy("id").limit(count), "id", index="place").select("place", "name")


def concatenated(named: DataFrame, synthetic: DataFrame, order: str = "position") -> DataFrame:
    """The whole population: named people first, each part in its order, with user_id as their place."""
    both = named.withColumn("_part", F.lit(0)).unionByName(synthetic.withColumn("_part", F.lit(1)))
    return indexed(both, "_part", order).drop("_part")


def faulty_json(rows: DataFrame, required: tuple[str, ...], whole: str = "age") -> DataFrame:
    """(user_id, problem) of records as read: required fields that are missing or blank, and a field that is no whole number."""
    kinds = dict(rows.dtypes)
    checks = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"{c} is blank") for c in required if c in kinds]
    checks += [F.lit(f"no {c}") for c in required if c not in kinds]
    if whole in kinds:
        text = F.col(whole).cast("string")
        checks.append(F.when(text.isNotNull() & text.try_cast(T.LongType()).isNull(), f"{whole} is no whole number"))
    return rows.select("user_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
