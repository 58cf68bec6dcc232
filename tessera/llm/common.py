"""What the training-data operators share: tables, shared storage, word hashing."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_name = ctypes.util.find_library("c")
_LIBC = ctypes.CDLL(_name) if _name and hasattr(ctypes.CDLL(_name), "malloc_trim") else None
#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000
#: Characters of whole texts that a worker takes from a batch at once.
SLICE = 2_000_000
#: Texts go through the word splitter in pieces of about this many bytes.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors see.

    On a single machine (tests) a local folder is set where the setting is
    absent; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write to shared storage and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count is known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def slices(texts: list, chars: int = SLICE):
    """Positions (from, to) that cut a list of texts, each whole, at about so many characters."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas over rows that hold whole texts."""
    narrow(df.sparkSession)
    return df.mapInPandas(run, schema)


def narrow(spark: SparkSession) -> None:
    """Whole texts go to Python ``BATCH_ROWS`` a batch where the session has Spark's default."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and position of every element of concatenated rows."""
    lengths = np.asarray(lengths, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.cumsum(lengths) - lengths
    return row, np.arange(int(lengths.sum())) - start[row]


# A word is a run of ASCII letters and digits or of bytes above 127.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        base = np.full(max(n, 4096), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _POWERS[0] = np.cumprod(base)
    return _POWERS[0]


def _split(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of one piece."""
    data = np.frombuffer(raw, np.uint8)
    word = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    inside = data[word]
    size = end - start
    first = np.cumsum(size) - size
    pos = np.arange(len(inside)) - np.repeat(first, size)
    value = _BYTE[inside] * _powers(int(size.max()))[pos]
    return start, end, mix64(np.add.reduceat(value, first))


def _pieces(texts: list[str]):
    """(row, text) with long texts cut at white space, so no word is cut."""
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE:
            cut = at + PIECE
            while cut < len(text) and not text[cut].isspace():
                cut += 1
            yield row, text[at:cut]
            at = cut
        yield row, text[at:] if at else text


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of all texts, and the words per text.

    The same word gets the same hash in any text; punctuation separates words.
    """
    counts = np.zeros(len(texts), np.int64)
    found, held, rows, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        raw = [x.lower().encode("utf-8", "surrogatepass") for x in held]
        start, _, value = _split(b"\n".join(raw))
        ends = np.cumsum([len(x) + 1 for x in raw])
        per = np.diff(np.searchsorted(start, ends), prepend=0)
        np.add.at(counts, rows, per)
        found.append(value)
        held.clear()
        rows.clear()
        size = 0

    for row, piece in _pieces(texts):
        held.append(piece)
        rows.append(row)
        size += len(piece)
        if size >= PIECE:
            flush()
    flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts
