"""What the operators share: Arrow mapping, hashing of words and n-grams, and files in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of documents are hashed in chunks of about so many bytes, which stay in the processor's cache.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process (tests) may it be unset: then a temporary folder serves."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that written made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most, so that what Python makes of their texts stays small; at the end unused memory goes back, as workers live on."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))
        pa.default_memory_pool().release_unused()


def columns_added(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., dict]],
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns (or those in keep) and new ones, computed from Arrow batches without a shuffle.

    make runs once in each task and returns a function from the input columns (Arrow arrays, in the order of inputs) to
    {new column: values}. A row may also be dropped: if the result has an entry "keep_rows", it is a mask. A new column
    replaces one of df of the same name. Rows, repeated ones too, are treated one by one.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    needed = list(dict.fromkeys([*kept, *inputs]))
    source = df.select(*[F.col(f"`{c}`") for c in needed])
    schema = T.StructType([f for f in source.schema.fields if f.name in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        apply = make()
        for batch in sliced(batches):
            got = apply(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
            mask = got.pop("keep_rows", None)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=target.field(f.name).type) for f in fields for x in [got[f.name]]]
            out = pa.RecordBatch.from_arrays(arrays, names=[*kept, *[f.name for f in fields]])
            yield out if mask is None else out.filter(pa.array(mask))

    return source.mapInArrow(run, schema)


# ---- hashing -------------------------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
#: Odd multipliers; fixed values, 64 bits of the golden ratio and of the square roots of 2 and 3, made odd.
_BYTE_MUL, _GRAM_MUL, _SECOND_MUL = 0x9E3779B97F4A7C15, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS, _GRAMS2 = _Powers(_BYTE_MUL), _Powers(_GRAM_MUL), _Powers(_SECOND_MUL)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_MUL))


#: Long buffers are hashed in pieces of so many values, so that what is held beside the results stays small.
PIECE = (1 << 20) - 1


def rolling(values: np.ndarray, k: int, powers: _Powers, prepared: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """A hash of each k consecutive values: a difference of prefix sums, moved to the place 0. Pieces overlap by k - 1, and each begins with the power 0."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        part = values[a : b + k - 1]
        up, down = powers.upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((prepared(part) if prepared else part) * up, out=sums[1:])
        out[a:b] = mixed((sums[k:] - sums[:-k]) * down[: b - a] + np.uint64(k))
    return out


def _bounds(buffer: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    starts, ends, before = [], [], False
    for a in range(0, len(buffer), PIECE):
        inside = is_word[buffer[a : a + PIECE]]
        step = np.diff(inside.view(np.int8), prepend=np.int8(before))
        starts.append(np.flatnonzero(step == 1) + a)
        ends.append(np.flatnonzero(step == -1) + a)
        before = bool(inside[-1])
    if before:
        ends.append(np.array([len(buffer)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word the sum of its bytes' numbers times powers, in pieces: a word that goes on in the next piece gets what is there times the power of what it had."""
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(buffer), PIECE):
        part = buffer[a : a + PIECE]
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, a + len(part)))
        if lo == hi:
            continue
        up, down = _BYTES.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[:-1], out=sums[1:])
        begin, end = np.maximum(starts[lo:hi] - a, 0), np.minimum(ends[lo:hi] - a, len(part))
        value = (sums[end] - sums[begin]) * down[begin]
        if starts[lo] < a:
            value[0] *= np.uint64(pow(_BYTE_MUL, a - int(starts[lo]), 1 << 64))
        out[lo:hi] += value
    return mixed(out + (ends - starts).astype(np.uint64) * np.uint64(_SECOND_MUL))


class Words:
    """The words of some texts, which were joined into one buffer: places, hashes and the text of each."""

    def __init__(self, data: bytes, offsets: np.ndarray, is_word: np.ndarray) -> None:
        """data: the texts' bytes, each followed by a separator; offsets: where each begins, and the end; is_word: by byte."""
        self.data = data
        self.starts, self.ends = _bounds(np.frombuffer(data, np.uint8), is_word)
        #: For text i: its words are those from first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = _word_hashes(np.frombuffer(data, np.uint8), self.starts, self.ends)

    def grams(self, k: int, second: bool = False) -> np.ndarray:
        """Hashes of each k consecutive words, by the first one's number; across texts too, which callers mask."""
        return rolling(self.hashes, k, _GRAMS2 if second else _GRAMS, (lambda x: mixed(x + np.uint64(_BYTE_MUL))) if second else None)

    def within(self, k: int) -> np.ndarray:
        """For each k consecutive words: whether one text holds them all."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return text[k - 1 :] == text[:n]

    def text(self, i: int, k: int) -> bytes:
        """Words i to i + k, joined by one space."""
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[i : i + k], self.ends[i : i + k], strict=True))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """The texts in groups of about CHUNK_BYTES: the first one's number, the joined bytes, and where each begins."""
    start = size = 0
    for i, t in enumerate([*texts, None]):
        if t is None or (size and size + len(t) > CHUNK_BYTES):
            if group := texts[start:i]:
                offsets = np.cumsum([0, *[len(x) + 1 for x in group]])
                yield start, b" ".join(group) + b" ", offsets
            start, size = i, 0
        if t is not None:
            size += len(t) + 1


def utf8(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def byte_class(words: str) -> np.ndarray:
    """A table over bytes: True for those of the given set ("plain": 0-9, a-z and all beyond ASCII; "nonspace": all but space and 9 to 13)."""
    out = np.zeros(256, bool)
    if words == "plain":
        out[48:58] = out[97:123] = out[128:] = True
    else:
        out[:] = True
        out[32] = False
        out[9:14] = False
    return out


#: bytes.translate table: A-Z in lower case, all else unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
