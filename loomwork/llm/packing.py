"""Best-fit packing: bounded-space online best-fit over open bins in a bitset keyed by free space."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import sliced, texts_of, written

SEQUENCE_TOKENS = 4096
#: Bins that may be open at once in a task.
OPEN_BINS = 1024
#: A task packs about this many tokens: thousands of sequences, so that those left open at its end weigh little.
TASK_TOKENS = SEQUENCE_TOKENS * 2048
END_ID = 1
#: Words, and pieces of words, whose ids a task remembers.
CACHED_WORDS = 300_000
#: Printable ASCII and the letters of Latin-1, for which normalizing is lower-casing, and the tokenizer's pattern for them (fixed values).
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


class _PieceIds(dict):
    """Ids of a piece of lower-case ASCII and Latin-1 letters, as little-endian 32-bit numbers."""

    def __init__(self, tokenizer) -> None:
        self.model = tokenizer.model
        #: A letter's bytes in the tokenizer's byte alphabet.
        self.letters = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(piece.translate(self.letters)))
        if len(piece) <= 64:
            self[piece] = out
        return out


class _WordIds(dict):
    """Ids of a stretch without blanks or line ends.

    The tokenizer's pattern never crosses white space and its normalizer treats each character run by itself, so the ids
    of a text are those of its stretches, one after another. Plain stretches are split here, so that their pieces can be
    looked up; all others, and what may hold a special token, go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _PieceIds(self.tokenizer)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if _LATIN(word) and "<|" not in word:
            out = b"".join(map(self.pieces.__getitem__, _LATIN_PIECES(word.lower())))
        else:
            out = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= 64:
            self[word] = out
        return out


@lru_cache(maxsize=2)
def _word_ids(path: str) -> _WordIds:
    """One for each worker, which runs one task after another."""
    return _WordIds(path)


def token_bytes(words: _WordIds, text: str) -> bytes:
    return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32. A null or empty text is one piece: the end id."""
    source = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for batch in sliced(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(texts_of(batch.column(1))):
                ids = token_bytes(words, text) + end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(row)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def best_fit(lengths: Iterable[int], size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """(bin, offset) of each length, in order.

    An item goes to the open bin with the least free space that holds it; among equals, to the one opened last. If there is
    none, a bin opens; if too many are open then, the fullest one closes. free: bit f is set if an open bin has f free.
    """
    free, bins, count, new = 0, {}, 0, 0
    for n in lengths:
        fits = free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            stack = bins[f]
            at = stack.pop()
            if not stack:
                del bins[f]
                free ^= 1 << f
            count -= 1
        else:
            f, at, new = size, new, new + 1
        yield at, size - f
        if left := f - n:
            bins.setdefault(left, []).append(at)
            free |= 1 << left
            count += 1
            if count > open_bins:
                f = (free & -free).bit_length() - 1
                bins[f].pop(0)
                count -= 1
                if not bins[f]:
                    del bins[f]
                    free ^= 1 << f


def packed(parts: DataFrame, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt by a hash of all they have and of their row in parts, a written table, over as many tasks as their
    tokens ask for, so that no id or repeated row fills a task. In a task they arrive longest first, ties by document and
    place, so a task that runs again packs alike; a full piece passes straight through.
    """
    total = parts.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(total / task_tokens))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        kept = list(batches)
        places = best_fit((n for b in kept for n in b.column(3).to_pylist()), size, open_bins)
        for b in kept:
            got = [next(places) for _ in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], names=schema.names)

    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = parts.select(*columns, F.monotonically_increasing_id().alias("row")).select(*columns, F.xxhash64(*columns, "row").alias("deal")).repartition(tasks, "deal")
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32").select(*columns).mapInArrow(run, schema)


def best_fit_packing(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs whole documents into sequences of at most size tokens, cutting only those that are longer.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one end id; a null id or
    a repeated row is packed like any other; an empty table gives no rows; other columns are left out.
    """
    return packed(written(pieces(documents, tokenizer_path, id_col, text_col, size), "pieces"), size, open_bins)
