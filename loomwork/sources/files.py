"""Profiles, reports and documents from files, and profiles to files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.sources import encodings
from loomwork.sources.shared import exists, removed

MOST_BYTES = 50 << 20
EXTENSIONS = (".txt", ".md", ".markdown")
RUN_ID, REPORT_ID = (kind + r"-\d{8}-\d{6}-[0-9a-f]{6}" for kind in ("sim", "rep"))

PROFILE = T.StructType(
    [T.StructField("user_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("username", "name", "provenance", "occupation", "activity_level")], T.StructField("interests", T.ArrayType(T.StringType()))]
)


class RunNotReadable(LookupError):
    """A run whose folder isn't there."""


def opened(spark: SparkSession, folder: str) -> Callable[[str, T.StructType], DataFrame]:
    """A reader of a run's tables by name and schema, where a table that is absent has no rows. A folder that is absent is an error."""
    if not exists(spark, folder):
        raise RunNotReadable(folder)
    return lambda name, schema: table_or_empty(spark, f"{folder}/{name}.parquet", schema)


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows of its schema if there's none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole files of one JSON document each: ontologies, settings, reports."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def asked(spark: SparkSession, text: str, tables: dict[str, DataFrame], **arguments: object) -> DataFrame:
    """SQL over the named tables (in braces) with parameters (:name). A parameter without a value is refused, rather than taken as null."""
    if missing := set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", re.sub(r"'[^']*'", "''", text))) - set(arguments):
        raise ValueError(f"no value for {', '.join(sorted(missing))}")
    return spark.sql(text, args=arguments, **tables)


def population(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from JSON arrays; those without an id, or with one below 0, are skipped."""
    return spark.read.schema(PROFILE).option("multiLine", True).json(path).where("user_id >= 0")


def partial(spark: SparkSession, path: str, schema: T.StructType, index: str = "index") -> DataFrame:
    """JSON lines of which some may be torn: these are skipped. The last line for an index counts, by file and place in it."""
    torn = T.StructType([*schema.fields, T.StructField("_torn", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = lines.select("_file", "_block", "_line", F.from_json("value", torn, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r")).where(f"r is not null and r._torn is null and r.`{index}` is not null")
    last = F.max_by("r", F.struct("_file", "_block", "_line"))
    return rows.groupBy(F.col(f"r.`{index}`").alias("_index")).agg(last.alias("r")).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])


def folders(spark: SparkSession, folder: str, schema: T.StructType, named: str, key: str, limit: int | None = None) -> DataFrame:
    """The JSON documents in folders whose names match, with the name as key, newest first, as names begin with their time; a name may stand behind the key's own, as partitions have it."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    found = rows.withColumn(key, F.regexp_extract("_metadata.file_path", rf"/(?:{key}=)?({named})/[^/]+\.json$", 1)).where(F.col(key) != "").orderBy(F.desc(key))
    return found if limit is None else found.limit(limit)


def runs(spark: SparkSession, folder: str, schema: T.StructType, graph_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The runs of a folder, newest first, of one graph or of all."""
    found = folders(spark, folder, schema, RUN_ID, "sim_id")
    found = found if graph_id is None else found.where(F.col("graph_id") == graph_id)
    return found if limit is None else found.limit(limit)


def reports(spark: SparkSession, folder: str, schema: T.StructType, sim_id: str | None = None) -> DataFrame:
    """The reports of a folder, newest first, with their summaries' first 200 characters and how many of their references were checked and found."""
    found = folders(spark, folder, schema, REPORT_ID, "report_id")
    found = found if sim_id is None else found.where(F.col("sim_id") == sim_id)
    return found.select("report_id", "sim_id", F.substring("summary", 1, 200).alias("summary"), F.coalesce("grounding.checked", F.lit(0)).alias("checked"), F.coalesce("grounding.resolved", F.lit(0)).alias("resolved"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, encoding, problem) of text files, decoded where they are read; what can't be used says why. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return decoded_files(files)


def decoded_files(files: DataFrame, most_bytes: int | None = MOST_BYTES, weights: encodings.Weights | None = None) -> DataFrame:
    """(path, text, encoding, problem) of files (path, length, content), of any length if most_bytes is None; weights, from encodings.learned, tell encodings that have no mark."""
    large = F.lit(False) if most_bytes is None else F.col("length") > most_bytes
    files = files.select("path", "length", F.when(~large, F.col("content")).alias("content"))
    name = F.lower("path")
    allowed = F.lit(False)
    for e in EXTENSIONS:
        allowed = allowed | name.endswith(e)
    why = F.when(~allowed, "extension").when(large, "too large").when(F.col("length") == 0, "empty")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [decoded(c, weights) if c and p is None else (None, None) for c, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string()), batch.column(2)], names=["path", "text", "encoding", "problem"])

    return files.select("path", "content", why.alias("problem")).mapInArrow(run, "path string, text string, encoding string, problem string")


def decoded(data: bytes, weights: encodings.Weights | None = None) -> tuple[str, str]:
    """Text and encoding: a byte order mark, strict UTF-8, what reads best by weights (see encodings) if there are any, Windows-1252, UTF-8 with replacements, whichever comes first."""
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    guesses = [e for m, e in marks if data.startswith(m)][:1] + ["utf-8"]
    for encoding in guesses:
        if (text := encodings.decoding(data, encoding)) is not None:
            return text, encoding
    if weights is not None and (found := encodings.likely(data, weights)):
        return found
    text = encodings.decoding(data, "cp1252")
    return (data.decode("utf-8", "replace"), "utf-8") if text is None else (text, "cp1252")


def ordered_blocks(blocks: DataFrame, wide: float = 0.65) -> DataFrame:
    """Text blocks (page, width, x0, x1, y0) of two-column pages in reading order: a block over most of the width parts the page; between such, the left column comes before the right one, and before what straddles the middle."""
    order = Window.partitionBy("page").orderBy("y0", "x0")
    full = (F.col("x1") - F.col("x0")) >= wide * F.col("width")
    region = F.sum(F.when(full, 1).otherwise(0)).over(order)
    side = F.when(full, -1).when(F.col("x1") <= F.col("width") / 2, 0).when(F.col("x0") >= F.col("width") / 2, 1).otherwise(2)
    return blocks.withColumns({"region": region, "side": side}).withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("region", "side", "y0", "x0")))


def write_profiles(people: DataFrame, folder: str) -> None:
    """Profiles as CSV, with a header, and as JSON lines; arrays as one text in the CSV."""
    flat = [F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in people.dtypes]
    people.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    people.write.mode("overwrite").json(f"{folder}/json")


def faults(profiles: DataFrame, required: tuple[str, ...] = ("user_id", "username", "name")) -> DataFrame:
    """(user_id, problem): missing or blank fields, and ids that come twice."""
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"{c} is blank")) for c in required]))
    rows = profiles.select("user_id", F.explode(blank).alias("problem"))
    twice = profiles.groupBy("user_id").count().where("count > 1").select("user_id", F.lit("id comes twice").alias("problem"))
    return rows.unionByName(twice)


def cached(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """keys (key) with the cache's vector, null where it has none; a key is looked up once, however often it is asked for."""
    return keys.join(keys.select("key").distinct().join(cache.select("key", "vector"), "key"), "key", "left")


def scored_rows(rows: DataFrame) -> DataFrame:
    """Scores (post_id, score, stance, rationale) as they are stored: the rationale's blanks collapsed, 200 characters at most."""
    return rows.select("post_id", "score", "stance", F.substring(F.trim(F.regexp_replace("rationale", r"\s+", " ")), 1, 200).alias("rationale"))


def dropped(spark: SparkSession, path: str, column: str, value: object) -> bool:
    """Deletes one partition of a table that is partitioned by column: a graph, a run, a model's vectors or a report. False if there was none."""
    return removed(spark, f"{path}/{column}={value}")
