"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if a count has shown that it has at most this many narrow rows.
BROADCAST_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that its lineage ends in files all executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the master is one
    machine (tests) a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Has ``df`` at most that many rows? It must be cheap to count (checkpointed); no more than one row beyond is read a partition."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    ``df`` must be cheap to count (checkpointed).
    """
    return F.broadcast(df) if at_most(df, rows) else df


def with_struct(df: DataFrame, found: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns ``drop``, with the fields of the struct ``found`` as columns, in place of columns of these names.

    The one rule for output columns of the operators that keep their input's: an operator's own columns win.
    """
    fields = df.select(found.alias("f")).schema["f"].dataType.names
    taken = {c.lower() for c in (*fields, *drop)}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    row = df.select(F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"), found.alias("found"))
    return row.select(*(["rest.*"] if rest else []), "found.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a batch between Spark and Python, where Spark's own limit is higher: texts of a batch are held several times on both sides.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to ``BATCH_ROWS``; only the memory of a task depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: What operators keep in a worker from task to task: by owner, how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Says that ``owner`` keeps something in its worker, which ``drop`` lets go of."""
    _KEPT[owner] = drop


def drop_others(owner: str = "") -> None:
    """Lets go of what other operators than ``owner`` have kept in this worker: a session's stages share their workers."""
    for name, drop in _KEPT.items():
        if name != owner:
            drop()


@functools.cache
def _malloc_trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives the memory that this worker has freed back to the machine; the allocators would keep it while the worker idles."""
    pa.default_memory_pool().release_unused()
    if call := _malloc_trim():
        call(0)


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` over the frames of a task, in a worker without what other operators kept, which is trimmed before and after. Only memory depends on it."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_others()
        trim()
        try:
            yield from run(frames)
        finally:
            trim()

    return task


def grouped_frames(batches: Iterator[pd.DataFrame], keys: list[str], max_rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Re-cuts frames of a partition sorted by ``keys`` so that no key is split over two frames.

    Frames grow only as far as one key's rows need.
    """
    held: list[pd.DataFrame] = []
    count = 0
    for frame in batches:
        if not len(frame):
            continue
        held.append(frame)
        count += len(frame)
        if count < max_rows:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = np.ones(len(whole), bool)
        for k in keys:
            last &= (whole[k] == whole[k].iloc[-1]).to_numpy()
        at = len(whole) - int(last.sum())
        if at:
            yield whole.iloc[:at]
        held, count = [whole.iloc[at:]], len(whole) - at
    if held:
        yield pd.concat(held, ignore_index=True)


# --- rolling hashes over bytes, modulo 2**64 ---------------------------------------------------

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Longest stretch that is hashed at once; longer texts go piece by piece.
CHUNK = 1 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of table[data[t]] * base**t for i <= t < j."""
    up, _ = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=s[1:])
    return s


def window_hashes(s: np.ndarray, width: int) -> np.ndarray:
    """The mixed hash of each stretch of ``width`` bytes, from its prefix hashes."""
    n = len(s) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _powers(n)
    return splitmix((s[width:] - s[:n]) * down[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _words_of(part: bytes) -> np.ndarray:
    a = np.frombuffer(part, np.uint8)
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    s = prefix_hash(a)
    _, down = _powers(len(a) + 1)
    return splitmix((s[end] - s[begin]) * down[begin] ^ ((end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def word_hashes(text: str | bytes) -> np.ndarray:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in order."""
    data = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower()
    if len(data) <= CHUNK:
        return _words_of(data)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        parts.append(_words_of(data[at:stop]))
        at = stop
    return np.concatenate(parts)


_MIXERS = splitmix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence."""
    if not text:
        return np.zeros(0, np.uint64)
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * _MIXERS[j % 64]
    return np.unique(splitmix(out))


# --- which keys have more than one owner ---------------------------------------------------------

#: Rows that a task combines at a time, and their schema.
FLUSH_ROWS = 500_000
COMBINED = "route bigint, key bigint, owner bigint, shared boolean"


def combined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Rows of (keys, owners, shared) arrays, each key once an owner, combined before their shuffle.

    A key that two owners in the task have is shared for certain: one of its rows goes to the key's own
    place and the others, marked, are spread. So however frequent a key, its place gets a row a task.
    """
    keys, owners, again = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, owners, again = keys[order], owners[order], again[order]
    same = np.zeros(len(keys), bool)  # as the row before
    same[1:] = keys[1:] == keys[:-1]
    met = same.copy()
    met[:-1] |= same[1:]
    route = np.where(same, splitmix(keys ^ splitmix(owners.view(np.uint64))), keys)
    for at in range(0, len(keys), 100_000):
        part = slice(at, at + 100_000)
        yield pd.DataFrame({"route": route[part].view(np.int64), "key": keys[part].view(np.int64), "owner": owners[part], "shared": (again | met)[part]})


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, owner) of combined rows whose key more than one owner has, or that are marked as shared. One shuffle."""
    same = Window.partitionBy("route")
    told = rows.withColumn("any", F.max("shared").over(same) | (F.min("owner").over(same) != F.max("owner").over(same)))
    return told.where("any").select("key", "owner")


def default_tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; WAYGRAPH_TOKENIZERS names another folder."""
    if folder := os.environ.get("WAYGRAPH_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
