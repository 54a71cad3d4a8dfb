"""Document fingerprints from prefix polynomial hashes.

For a text of n code points two modular prefix arrays are kept, one for each prime. They give the
hash of any span in constant time, so that spans can be compared without reading them, and the
longest common extension of two positions is found by binary search. A fingerprint has the text's
length, the hash of its whole span under both primes, and a sketch: of the hashes of all spans of
``WIDTH`` code points, the least in each of ``BINS`` bins, kept as one byte.

Defined results: a null text counts as empty; the empty text has a fingerprint of its own; a text
shorter than ``WIDTH`` has one span, itself. Rows that repeat a doc_id are ordered by a hash of the text, then by the text; rows
without a doc_id come first. A very long text is one row like others, its arrays 16 bytes a code point. The last row's next is the first,
so a single row's next is itself. An empty table gives an empty table. Other columns don't matter, whatever their names:
``fingerprint_neighbours`` leaves them out, ``fingerprint_documents`` keeps all but one of its output's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, splitmix, with_struct

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
WIDTH, BINS = 20, 64
_U = np.uint64
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime: powers of its base and of the base's inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(1 << 15, 1 << (n - 1).bit_length())
        made = []
        for p, b in zip(PRIMES, BASES):
            pair = []
            for x in (b, pow(b, -1, p)):
                a = np.ones(1, _U)
                while len(a) < size:
                    a = np.concatenate([a, a * _U(pow(x, len(a), p)) % _U(p)])
                pair.append(a)
            made.append(tuple(pair))
        _POWERS[:] = made
    return _POWERS


class PrefixHashes:
    """Prefix arrays of one text; spans are [i, j) in code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
        self.n = len(codes)
        self._sums = []
        for p, (up, _) in zip(PRIMES, _powers(self.n + 1)):
            s = np.zeros(self.n + 1, _U)
            np.cumsum(codes * up[: self.n] % _U(p), out=s[1:])
            self._sums.append(s % _U(p))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash pair of a span, the same wherever the span stands."""
        return tuple((int(s[j]) - int(s[i])) * int(down[i]) % p for s, p, (_, down) in zip(self._sums, PRIMES, _powers(self.n + 1)))

    def windows(self, width: int) -> np.ndarray:
        """The mixed hashes of all spans of ``width``, under the first prime."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, _U)
        p, s, down = PRIMES[0], self._sums[0], _powers(self.n + 1)[0][1]
        return splitmix((s[width:] + _U(p) - s[:m]) % _U(p) * down[:m] % _U(p))

    def extension(self, other: PrefixHashes, i: int = 0, j: int = 0) -> int:
        """The length of the longest common extension of position i here and position j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def back_extension(self, other: PrefixHashes, i: int, j: int) -> int:
        """The same to the left: of what ends before i here and before j there."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i - mid, i) == other.span(j - mid, j):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        h1, h2 = self.span(0, self.n)
        w = np.sort(self.windows(min(WIDTH, self.n))) if self.n else np.zeros(0, _U)
        shift = _U(64 - (BINS.bit_length() - 1))
        first = np.searchsorted(w, np.arange(BINS, dtype=_U) << shift)
        sketch = np.zeros(BINS, np.uint8)
        full = np.flatnonzero(first < len(w))
        full = full[(w[first[full]] >> shift) == full.astype(_U)]
        sketch[full] = 1 + (splitmix(w[first[full]]) % _U(255)).astype(np.uint8)
        return f"{self.n:x}-{h1:08x}{h2:08x}-{sketch.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of spans in common (twice the common ones over both), as the sketches tell; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), np.uint8) for f in (a, b))
    either = int(((x > 0) | (y > 0)).sum())
    if not either:
        return 0.0
    same = int(((x == y) & (x > 0)).sum())
    j = max(0.0, (same / either - 1 / 255) / (1 - 1 / 255))
    return round(2 * j / (1 + j), 6)


def fingerprint_text(text: str | None) -> str:
    return PrefixHashes(text or "").fingerprint()


def fingerprint_documents(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with a fingerprint of each text; no shuffle."""

    @F.pandas_udf("string")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint_text)

    return with_struct(df, F.struct(fingerprints(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias(out_col)))


_OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, lce_edited bigint, lce_next bigint"
)
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


class _Doc:
    """One row with what is known of its text; built once, used as a text and as the next one's."""

    def __init__(self, doc_id, text):
        self.doc_id, self.text = doc_id, text or ""
        self.hashes = PrefixHashes(self.text)
        self.print = self.hashes.fingerprint()

    def against(self, other: _Doc) -> tuple:
        n = len(self.text)
        edited = self.text[: n - n // 2] + other.text[: n // 2]
        e = PrefixHashes(edited)
        f = e.fingerprint()
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (
            self.doc_id, n, sha, self.print, f, likeness(self.print, f), likeness(self.print, other.print),
            self.hashes.extension(e), self.hashes.extension(other.hashes),
        )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[*_COLUMNS, "pid", "last", "text"])
    for c in ("doc_id", "n_chars", "lce_edited", "lce_next", "pid"):
        out[c] = out[c].astype("Int64")
    return out


def _within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range of doc_ids in order. What the range's ends need from outside goes on with its text."""
    pid = TaskContext.get().partitionId()
    before: _Doc | None = None
    blank = (None,) * 8
    rows: list[tuple] = []
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            doc = _Doc(None if pd.isna(doc_id) else int(doc_id), text)
            if before is None:
                rows.append((doc.doc_id, *blank, pid, False, doc.text))
            else:
                rows.append((*before.against(doc), None, None, None))
            before = doc
            if len(rows) >= 2000:
                yield _frame(rows)
                rows = []
    if before is not None:
        rows.append((before.doc_id, *blank, pid, True, before.text))
    if rows:
        yield _frame(rows)


def _between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last text of each range against the first of the next: rows of one border follow each other, the next range's first."""
    first: _Doc | None = None
    for frame in frames:
        rows: list[tuple] = []
        for doc_id, text, is_last in zip(frame["doc_id"], frame["text"], frame["last"]):
            doc = _Doc(None if pd.isna(doc_id) else int(doc_id), text)
            if is_last:
                rows.append(doc.against(first))
            else:
                first = doc
        if rows:
            out = pd.DataFrame(rows, columns=_COLUMNS)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are to each other and to the next document's.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many
    of the next document's, by ascending id; the last document's next is the first. One shuffle
    brings each range of ids together in order; then the two texts at each border between ranges meet, each border by itself.
    Rows of one doc_id are spread over ranges by a hash of their texts.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    slim = slim.select("*", F.xxhash64("text").alias("h"))
    ranged = slim.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    done = cut(ranged.mapInPandas(_within, f"{_OUT}, pid bigint, last boolean, text string"))
    ends = done.where("pid is not null").select("doc_id", "text", "pid", "last")
    used = sorted(r.pid for r in ends.select("pid").distinct().collect())  # numbers of partitions
    borders = spark.createDataFrame([(p, used[(k + 1) % len(used)]) for k, p in enumerate(used)], "pid bigint, after bigint")
    ends = ends.join(F.broadcast(borders), "pid").withColumn("border", F.when(F.col("last"), F.col("after")).otherwise(F.col("pid")))
    ends = ends.repartition(partitions(spark), "border").sortWithinPartitions("border", "last").select("doc_id", "text", "last").mapInPandas(_between, _OUT)
    return done.where("pid is null").select(*_COLUMNS).unionByName(ends)
