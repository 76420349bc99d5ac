"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

#: Letters that the contracts lower-case, and the bytes that separate words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"



def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a temporary one on a local master; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discarded(df: DataFrame) -> None:
    """Removes a table that written() has made; nothing may read it any more."""
    jvm, path = df.sparkSession._jvm, df.stored_at
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: The number of a row without id: it counts as the largest.
NULL_ID = np.iinfo(np.int64).max


def ranked(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """docs with `_number`, a long in the order of the ids, equal for equal ids and null for a null one; and where ids are no whole numbers, the table (_id, _number) that tells their ranks."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return docs.withColumn("_number", F.col(id_col).cast("long")), None
    ids = docs.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct()
    ranks = written(ids.orderBy("_id").withColumn("_number", F.monotonically_increasing_id()), "ranks")
    return docs.drop("_number").join(ranks, F.col(id_col) == F.col("_id"), "left").drop("_id"), ranks


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds `_number`, a long in the order of the ids; that of a row without id is the largest."""
    return ranked(docs, id_col)[0].withColumn("_number", F.coalesce("_number", F.lit(NULL_ID)))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of df; other columns are left behind, so their names cannot clash. A null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def struct_of(columns: tuple[str, ...]) -> Column:
    """Columns to be carried along, as one struct; a null string where there are none."""
    return F.struct(*(F.col(c) for c in columns)) if columns else F.lit(None).cast("string")


def with_rest(schema: str, df: DataFrame) -> StructType:
    """A schema of named columns, and df's own `rest` with its fields as they are (null or not)."""
    return StructType.fromDDL(schema).add("rest", df.schema["rest"].dataType)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose `column` holds about `limit` bytes, so that memory follows bytes and not row counts."""
    for batch in batches:
        sizes = byte_ends(batch.column(batch.schema.get_field_index(column)))
        start, n = 0, batch.num_rows
        while start < n:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_ends(column: pa.Array) -> np.ndarray:
    """Cumulative byte lengths of a column of strings, bytes or lists of 32-bit numbers; a null counts as empty."""
    import pyarrow.compute as pc

    sizes = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
    return np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls end to end, and where each value ends."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    return np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]), ends[1:] - ends[0]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the runs first..last, and the run of each."""
    sizes = last - first + 1
    run = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[run], run


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer over uint64 values; the same input gives the same output everywhere."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_TAIL = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)  # the low bytes that count
#: words with more bytes are hashed one by one
_LONG_WORD = 256


def string_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of stretches of bytes, mixed eight bytes at a time (for features; colliding ones can be made up, so nothing is decided by them alone)."""
    h = mixed(size.astype(np.uint64), salt)
    spare = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(spare, 8)
    rows = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    done = 0
    while len(rows):
        left = size[rows] - done
        w = eight[start[rows] + done].view("<u8").reshape(-1).astype(np.uint64)
        h[rows] = mixed(h[rows] ^ np.where(left >= 8, w, w & _TAIL[np.minimum(left, 7)]), salt)
        done += 8
        rows = rows[left > 8]
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + size[k]].tobytes(), digest_size=8, salt=bytes([salt])).digest(), "little")
    return h


def word_places(data: np.ndarray, ends: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of the words of texts that lie end to end, and the number of words of each text.

    A word is a run of bytes for which `within` is true; words never cross texts.
    """
    inside = within[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
    begin[cuts] = inside[cuts]
    stop[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1 - start, np.diff(np.searchsorted(start, ends, "left"), prepend=0)


class Numbers(dict):
    """Numbers of words, the next one for each new word; words are told apart by their bytes."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _digest(word: bytes) -> bytes:
    """64-bit digest of a word: a cryptographic hash, so no pair of words with one digest can be made up."""
    return hashlib.blake2b(word, digest_size=8, person=b"words").digest()


class _Digests(dict):
    """Digests of words as numbers; those of short words are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(_digest(word), "little")
        if len(word) <= 32:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = found
        return found


#: What a worker has met so far; it changes no result.
_MET = _Digests()


def _cut(values: list[bytes], of: dict, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What `of` gives for each word of texts, A-Z lower-cased, and how many words each text has."""
    parts, counts = [np.zeros(0, kind)], np.zeros(len(values), np.int64)
    for k, v in enumerate(values):
        words = v.lower().split()  # bytes: A-Z alone are lower-cased, and the six white-space bytes separate
        counts[k] = len(words)
        parts.append(np.fromiter(map(of.__getitem__, words), kind, len(words)))
    return np.concatenate(parts), counts


def word_numbers(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word of texts, how many words a text has, and the digest of each number's word."""
    known = Numbers()
    numbers, counts = _cut(values, known, np.int64)
    return numbers, counts, np.frombuffer(b"".join(map(_digest, known)), "<u8")


def all_word_hashes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of texts, A-Z lower-cased, and the number of words of each text."""
    return _cut(values, _MET, np.uint64)


def trimmed() -> None:
    """Gives memory that a finished group no longer needs back to the machine; a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
