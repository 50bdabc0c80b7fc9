"""Citations held against what a run has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import labelled, references


def facts(posts: DataFrame, agents: DataFrame, rounds: DataFrame, usernames: DataFrame) -> DataFrame:
    """(kind, value): all that may be referred to, as text, each once."""
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.lower(F.col(df.columns[0]).cast("string")).alias("value")).where("value is not null")
    return part(posts, "post").unionByName(part(agents, "agent")).unionByName(part(rounds, "round")).unionByName(part(usernames, "username")).distinct()


def cited(claims: DataFrame) -> DataFrame:
    """(where, kind, value) of claims (where, post_ids, agent_ids, rounds)."""
    none = F.expr("array()").cast("array<bigint>")
    pairs = [labelled(F.coalesce(c, none), kind) for c, kind in (("post_ids", "post"), ("agent_ids", "agent"), ("rounds", "round"))]
    return claims.select("where", F.explode(F.concat(*pairs)).alias("r")).select("where", "r.kind", "r.value")


def in_prose(texts: DataFrame) -> DataFrame:
    """(where, kind, value) of references in texts (where, text). Numbers lose leading zeros."""
    found = texts.select("where", F.explode(references(F.col("text"))).alias("r")).select("where", "r.kind", "r.value")
    number = F.regexp_replace("value", "^0+(?=.)", "")
    return found.withColumn("value", F.when(F.col("kind") == "username", F.lower("value")).otherwise(number))


def resolved(found: DataFrame, known: DataFrame) -> DataFrame:
    """References with resolved, by a left join with the facts, which are distinct."""
    return found.join(known.withColumn("_known", F.lit(True)), ["kind", "value"], "left").select("where", "kind", "value", F.coalesce("_known", F.lit(False)).alias("resolved"))


def counters(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("checked"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))


def unresolved_by_section(checked: DataFrame) -> DataFrame:
    """(section, n): a section is what stands before a bracket."""
    return checked.where("not resolved").groupBy(F.trim(F.split_part("where", F.lit("["), F.lit(1))).alias("section")).agg(F.count("*").alias("n"))
