"""Shared helpers: tables in the cluster's shared folder, word splitting, 64-bit mixing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="twinsift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; release() or the end of the driver removes it."""
    path = f"{shared_dir(spark)}/twinsift-{uuid.uuid4().hex}-{name}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost no more than their own tasks."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.made_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*made: DataFrame) -> None:
    """Removes tables of materialize() that nothing reads any more."""
    for df in made:
        _made[:] = [x for x in _made if x[1] != df.made_at]
        _delete(df.sparkSession, df.made_at)


def release() -> None:
    """Removes what work_path() handed out. Frames that read those tables can't be used any more."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder is then the cluster's to clear
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def settle() -> None:
    """Gives freed memory back to the system. A worker outlives its tasks, and what its allocators keep counts against the next ones."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.lower and bytes.split know just these ASCII characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_WORD = np.ones(256, bool)  # a byte of a word: anything but [\x20\x09-\x0D]
_WORD[[0x20, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIXED = mix(_LOWER.astype(U) + U(1))
#: Bytes hashed at once, and the longest words that are hashed together.
WINDOW, SHORT = 1 << 17, 256
_POWER = np.cumprod(np.concatenate(([U(1)], np.full(WINDOW, U(0xD6E8FEB86659FD93)))))
_UNPOWER = np.cumprod(np.concatenate(([U(1)], np.full(WINDOW, U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))))))


def hashed_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the words of documents that stand one after the other in data; first: where they begin, ascending."""
    hashes, places, lo, n = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0, len(data)

    def one(at: int, to: int) -> int:
        return xxhash.xxh3_64_intdigest(_LOWER[data[at:to]].tobytes())

    while lo < n:
        hi = min(lo + WINDOW, n)
        inner = first[np.searchsorted(first, lo, side="right") : np.searchsorted(first, hi, side="right")]
        word = _WORD[data[lo:hi]]
        if hi < n:  # no word may reach across the window's end
            gaps = np.flatnonzero(~word)
            cut = max(lo + int(gaps[-1]) + 1 if len(gaps) else lo, int(inner[-1]) if len(inner) else lo)
            if cut == lo:  # one word fills the window
                to = hi
                until = int(inner[0]) if len(inner := first[np.searchsorted(first, lo, side="right") :]) else n
                while to < until and not len(gaps := np.flatnonzero(~_WORD[data[to : min(to + WINDOW, until)]])):
                    to = min(to + WINDOW, until)
                to += int(gaps[0]) if to < until else 0
                hashes.append(np.array([one(lo, to)], U))
                places.append(np.array([lo]))
                lo = to
                continue
            hi, word, inner = cut, word[: cut - lo], inner[inner < cut]
        apart = np.zeros(hi - lo + 1, bool)
        apart[inner - lo] = True
        before, after = np.concatenate(([False], word[:-1])), np.concatenate((word[1:], [False]))
        at = np.flatnonzero(word & (~before | apart[:-1]))
        to = np.flatnonzero(word & (~after | apart[1:])) + 1
        total = np.concatenate(([U(0)], np.cumsum(_MIXED[data[lo:hi]] * _POWER[: hi - lo], dtype=U)))
        size = to - at
        h = mix((total[to] - total[at]) * _UNPOWER[at] ^ size.astype(U) << U(48))
        for i in np.flatnonzero(size > SHORT).tolist():
            h[i] = one(lo + int(at[i]), lo + int(to[i]))
        hashes.append(h)
        places.append(at + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(places)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows and of the end) of a string column; nulls are empty."""
    text = column.cast(pa.large_string()).fill_null("")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
