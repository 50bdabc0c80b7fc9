"""Vectors in cells around pivots, so that angles tell which cells can be left out.

A vector lives in the cell of its nearest pivot, whose radius is the largest angle of a member to the pivot. By the triangle inequality
of angles nothing in a cell is nearer to a vector than its angle to the pivot less the radius. Cells are compared in blocks of
bounded size with the vectors that visit them; members are never copied to all of these, and visitors go only where they must.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pivots at most, members of a cell for which there is a pivot, and members and visitors that are compared at once, about.
MOST_PIVOTS, MEMBERS, BLOCK = 256, 2048, 4096
#: Angles are taken as so much smaller than they come out, as they are rounded.
SLACK = 1e-6


def units(vectors: Iterable) -> np.ndarray:
    """Rows of length one; of null and zero vectors zeros."""
    rows = list(vectors)
    width = max((len(v) for v in rows if v is not None), default=0)
    x = np.array([v if v is not None else [0.0] * width for v in rows], np.float64).reshape(len(rows), width)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


@dataclass
class Cells:
    """Pivots of length one, and by cell the largest angle of a member, -1 without members."""

    pivots: np.ndarray
    radii: np.ndarray

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))


def _mapped(df: DataFrame, vector: str, fields: list[T.StructField], values: Callable[[np.ndarray, pa.RecordBatch], list]) -> DataFrame:
    """df with new columns, computed from its vectors in Arrow batches."""
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(vector)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                new = values(units(batch.column(at).to_pylist()), batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, target.field(f.name).type) for v, f in zip(new, fields, strict=True)]], schema=target)

    return df.mapInArrow(run, schema)


def cells_of(vectors: DataFrame, count: int, vector: str = "vector") -> tuple[Cells, DataFrame]:
    """The cells, and vectors with the cell of each. Pivots are vectors themselves, those of the least hashes: MOST_PIVOTS at most."""
    wanted = int(min(MOST_PIVOTS, max(1, count // MEMBERS)))
    own = F.xxhash64(F.col(vector))
    chosen = vectors.where(F.col(vector).isNotNull()).select(own.alias("h"), F.col(vector).alias("v")).orderBy("h").limit(wanted).collect()
    pivots = units(r.v for r in chosen)
    radii = np.full(max(1, len(pivots)), -1.0)
    placed = nearest_cell(vectors, Cells(pivots, radii), vector)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # as many rows as pivots
        radii[r.cell] = r.angle
    return Cells(pivots, radii), placed


def nearest_cell(df: DataFrame, cells: Cells, vector: str = "vector") -> DataFrame:
    """df with cell, that of the nearest pivot, and the angle to it."""
    shared = df.sparkSession.sparkContext.broadcast(cells.pivots)

    def home(x: np.ndarray, _: pa.RecordBatch) -> list:
        angle = np.arccos(np.clip(x @ shared.value.T, -1, 1)) if x.shape[1] and len(shared.value) else np.zeros((len(x), 1))
        cell = angle.argmin(axis=1)
        return [cell.astype(np.int32), angle[np.arange(len(x)), cell]]

    return _mapped(df, vector, [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())], home)


def visiting(df: DataFrame, cells: Cells, within: float | str, vector: str = "vector") -> DataFrame:
    """df with visits: the cells that may have members within an angle, which is a number or a column of df (null: any angle)."""
    shared = df.sparkSession.sparkContext.broadcast(cells)
    at = df.columns.index(within) if isinstance(within, str) else None

    def visits(x: np.ndarray, batch: pa.RecordBatch) -> list:
        own = shared.value
        reach = np.full(len(x), within) if at is None else batch.column(at).fill_null(4.0).to_numpy(zero_copy_only=False)
        angles = own.angles(x) if x.shape[1] and len(own.pivots) else np.zeros((len(x), len(own.radii)))
        near = (angles - own.radii <= reach[:, None] + SLACK) & (own.radii >= 0)
        return [[np.flatnonzero(row).astype(np.int32) for row in near]]

    return _mapped(df, vector, [T.StructField("visits", T.ArrayType(T.IntegerType()))], visits)


def compared(members: DataFrame, visitors: DataFrame, cells: Cells, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str | T.StructType, row: str = "row") -> DataFrame:
    """What fn makes of blocks of a cell's members and of those that visit it (visits); row tells rows apart, so that blocks are even.

    Every member of a cell meets every visitor of it in one call of fn.
    """
    counted = [df.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias(name)) for df, name in ((members, "m"), (visitors.select(F.explode("visits").alias("cell")), "v"))]
    parts = {r.cell: (r.m, r.v) for r in counted[0].join(counted[1], "cell").collect()}  # as many rows as cells
    table = visitors.sparkSession.createDataFrame([(c, m, v) for c, (m, v) in parts.items()], "cell int, m int, v int")
    dealt = lambda df, own, size, other, n: df.join(F.broadcast(table), "cell").withColumn(own, F.pmod(F.xxhash64(row), F.col(size))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop("m", "v")
    one = dealt(members, "i", "m", "j", "v")
    other = dealt(visitors.withColumn("cell", F.explode("visits")).drop("visits"), "j", "v", "i", "m")
    one, other = (df.withColumn("i", F.col("i").cast("int")).withColumn("j", F.col("j").cast("int")) for df in (one, other))
    other = other.toDF(*other.columns)  # columns of its own, where both come from one table
    return one.groupBy("cell", "i", "j").cogroup(other.groupBy("cell", "i", "j")).applyInArrow(lambda a, b: fn(a, b), schema)
