"""Suffix-array dedup: removal of every byte that a repeated string of ``LENGTH`` bytes covers.

1. Anchors. A window of LENGTH bytes has as its key the least hash of the stretches of ``STRETCH`` bytes in it.
   Equal windows have equal keys, and neighbouring windows mostly share one: a run of windows with
   one key is one row. Runs whose key no other text has can't repeat, and leave; most do.
2. Contexts. A run that is left is sent, with its bytes, to the other runs of its key. Of identical contexts
   one goes on, marked as repeated; the places of the others are settled, in the task that reads them where it has both.
3. Interval expansion. The contexts of many keys make a block. From its suffix array comes its
   Burrows-Wheeler transform; intervals of it are extended backwards, breadth first, so that common prefix lengths
   are found by increasing value; the search stops at LENGTH. Neighbours in suffix order that have no length by
   then share LENGTH bytes or more: their windows repeat. Contexts end with a symbol that is no byte, so that
   nothing matches over a border. The runs of a key that more than ``HOT_OWNERS`` texts have (counted) are not gathered: their windows are
   told by 128-bit BLAKE2b hashes of their bytes, which spread over all tasks; windows that a task has twice are settled there. The same goes
   for a key whose distinct contexts turn out too many (``HOT``) or too long (``HOT_BYTES``) to be gathered.
4. Removal. The covered bytes of each text are joined into spans and cut out.

Copies of whole texts are found by SHA-256 first; one of them stands for all in steps 2 and 3, and all
of them go whole (if they have LENGTH bytes), as each one's windows start in another. That a key has owners of
two texts is told by 64 bits: two texts that shared them (and a passage that no third text has) would keep that passage.

Defined results: a null text counts as empty; shorter texts than LENGTH keep all; matches don't cross
documents; any byte may occur in a text, NUL too; long texts are read in overlapping pieces; rows that share a doc_id and a text are copies
like any others; empty tables give empty tables. Other columns don't matter, whatever their names:
``remove_repeats`` leaves them out, ``without_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, COMBINED, FLUSH_ROWS, at_most, bounded, combined, cut, lean, partitions, prefix_hash, shared_keys, small_batches, window_hashes

LENGTH, STRETCH = 200, 88
#: Texts of one key whose runs are gathered at most.
HOT_OWNERS = 1_000
#: Distinct contexts of one key that are gathered at most, and their bytes.
HOT, HOT_BYTES = 4_000, 2 << 20
#: Bytes of a block, about.
BLOCK_BYTES = 1 << 20


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    m, span = h, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs_of(data: bytes, length: int = LENGTH, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, last, often): the runs of window starts of equal key, in order; keys whose stretch the data has more than once."""
    keys, first, last, often = [], [], [], []
    windows = len(data) - length + 1
    for at in range(0, max(0, windows), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK, windows - at) + length - 1, at)
        h = window_hashes(prefix_hash(part), stretch)
        m = _sliding_min(h, length - stretch + 1)
        begin = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        own = m[begin]
        keys.append(own)
        first.append(begin + at)
        last.append(np.append(begin[1:], len(m)) - 1 + at)
        low = np.sort(h[h <= own.max()])
        often.append(low[1:][low[1:] == low[:-1]])
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    keys = np.concatenate(keys)
    if len(often) > 1:  # a key of two pieces
        own, times = np.unique(keys, return_counts=True)
        often.append(own[times > 1])
    return keys, np.concatenate(first), np.concatenate(last), np.concatenate(often)


def _anchors(length: int, stretch: int):
    """The keys of each text's runs, once a text, as ``shared_keys`` takes them; shared is also a key whose stretch a text has more than once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple] = []
        held, seen = 0, set()
        for frame in frames:
            for tkey, text in zip(frame["tkey"], frame["text"]):
                if text is None or tkey in seen:
                    continue
                seen.add(tkey)
                keys, _, _, often = runs_of(text.encode("utf-8", "surrogatepass"), length, stretch)
                if not len(keys):
                    continue
                own = np.unique(keys)
                again = np.isin(own, often) if len(often) else np.zeros(len(own), bool)
                parts.append((own, np.full(len(own), tkey, np.int64), again))
                held += len(own)
                if held > FLUSH_ROWS:
                    yield from combined(parts)
                    parts, held, seen = [], 0, set()
        if parts:
            yield from combined(parts)

    return run


_CONTEXTS = "key bigint, uid bigint, first bigint, size bigint, again boolean, context binary"
_DIGEST = 16


def _digests(context: bytes, length: int) -> list[bytes]:
    """128 bits of BLAKE2b of each window."""
    return [hashlib.blake2b(context[k : k + length], digest_size=_DIGEST).digest() for k in range(len(context) - length + 1)]


class _Held:
    """Runs and windows of hot runs that a task has read and not passed on: each once, marked if it came again.

    The places of what came again are settled: rows without bytes, under a key of their own.
    """

    def __init__(self, length: int):
        self.length, self.n_bytes = length, 0
        self.runs: dict[tuple[int, bytes], tuple[int, int, bool, bool]] = {}
        self.windows: dict[bytes, tuple[int, int, bool]] = {}
        self.settled: list[tuple] = []

    def settle(self, uid: int, first: int, size: int) -> None:
        self.settled.append((uid + first, uid, first, size, True, None))

    def add(self, key: int, context: bytes, uid: int, first: int, hot: bool) -> None:
        known = self.runs.get((key, context))
        if known is not None:
            self.runs[key, context] = (*known[:2], True, hot)
            self.settle(uid, first, len(context))
            return
        self.runs[key, context] = (uid, first, False, hot)
        self.n_bytes += len(context)
        if not hot:
            return
        came = np.zeros(len(context) - self.length + 1, bool)
        for k, d in enumerate(_digests(context, self.length)):
            if (w := self.windows.get(d)) is None:
                self.windows[d] = (uid, first + k, False)
            else:
                came[k] = True
                self.windows[d] = (*w[:2], True)
        for a, b in zip(*_ranges(came)):
            self.settle(uid, first + int(a), int(b - a) - 1 + self.length)

    def full(self, flush_bytes: int) -> bool:
        return self.n_bytes > flush_bytes or len(self.settled) > FLUSH_ROWS or len(self.windows) > FLUSH_ROWS // 5

    def frame(self) -> pd.DataFrame:
        rows = []
        for (key, context), (uid, first, again, hot) in self.runs.items():
            if not hot:
                rows.append((key, uid, first, len(context), again, context))
            elif again:
                self.settle(uid, first, len(context))
        for d, (uid, first, again) in self.windows.items():
            rows.append((int.from_bytes(d[:8], "big", signed=True), uid, first, self.length, again, d))
        return pd.DataFrame(rows + self.settled, columns=["key", "uid", "first", "size", "again", "context"])


def _contexts(length: int, stretch: int, flush_bytes: int = 8_000_000):
    """The runs of a text that its list of shared keys names, with their bytes, or the windows of runs of hot keys.

    However frequent a run or a window, its key gets a row a flush.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(length)
        for frame in frames:
            for uid, text, shared, hot in zip(frame["uid"], frame["text"], frame["shared"], frame["hot"]):
                data = text.encode("utf-8", "surrogatepass")
                keys, first, last, _ = runs_of(data, length, stretch)
                hot = set(map(int, hot))
                for k in np.flatnonzero(np.isin(keys, np.asarray(shared, np.int64).view(np.uint64))):
                    key = int(keys[k : k + 1].view(np.int64)[0])
                    held.add(key, data[first[k] : last[k] + length], uid, int(first[k]), key in hot)
                    if held.full(flush_bytes):
                        yield held.frame()
                        held = _Held(length)
        if held.runs:
            yield held.frame()

    return run


# --- the block: suffix array, Burrows-Wheeler transform, interval expansion -----------------------


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in order of their first ``depth`` bytes at least; equal ones in any order.

    Symbols are below 512. Prefix doubling from seven of them on; each round sorts only the suffixes whose place is still open.
    """
    n = len(data)
    place = np.int32 if n + depth < 1 << 31 else np.int64
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key <<= np.uint64(9)
        key[: max(0, n - j)] |= data[j:]
    order = np.argsort(key).astype(place)
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    del key
    rank = np.zeros(n + depth, place)  # past the end: less than all
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=place), place(0))) + place(1)  # where each row's group begins
    have = 7
    while have < depth:
        alone = fresh & np.append(fresh[1:], True)
        rows = np.flatnonzero(~alone).astype(place)
        if not len(rows):
            break
        at = order[rows]
        second = rank[at + place(have)]
        by = np.argsort(rank[at].astype(np.int64) * (n + 2) + second)  # groups stay where they are: their ranks are their places
        order[rows] = at = at[by]
        first, second = rank[at], second[by]
        del by
        split = np.ones(len(rows), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        fresh[rows] = split
        rank[at] = np.maximum.accumulate(np.where(split, rows, place(0))) + place(1)
        have *= 2
    return order


def repeated_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """For each position: does its suffix share ``depth`` bytes with another suffix?

    Breadth-first backward extension on the transform. An interval [lo, hi) of suffixes that share
    ``level`` bytes, extended by a byte to the left, is again an interval; if the border at its end has no
    common prefix length yet, that length is ``level``, and the interval is extended further at the next level. Each border
    is set once, by increasing value; borders without a value after ``depth - 1`` have ``depth`` or more.
    """
    n = len(data)
    order = suffix_order(data, depth)
    place = order.dtype.type
    bwt = data[order - place(1)]  # the byte before each suffix, cyclic
    # where the row of a suffix goes when the byte before it is put in front: rows of one byte keep their order
    by_byte = np.argsort(bwt, kind="stable").astype(place)
    forth = np.empty(n, place)
    forth[by_byte] = np.arange(n, dtype=place)
    every, counts = np.unique(bwt, return_counts=True)
    starts = dict(zip(every.tolist(), (np.cumsum(counts) - counts).tolist()))
    rows_of = dict(zip(every.tolist(), np.split(by_byte, np.cumsum(counts)[:-1])))
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.zeros(1, place), np.full(1, n, place)
    for level in range(depth):
        size = hi - lo
        one = size == 1
        few = ~one & (size <= 256)
        new_lo, new_hi = [forth[lo[one]]], []
        new_hi.append(new_lo[0] + place(1))
        if few.any():
            f_lo, f_size = lo[few], size[few]
            rows = np.repeat(f_lo - (np.cumsum(f_size, dtype=place) - f_size), f_size)
            rows += np.arange(len(rows), dtype=place)
            # within an interval, the rows of one byte go to neighbouring places
            to = forth[rows]
            key = np.repeat(np.arange(len(f_lo), dtype=np.int32 if len(f_lo) < 1 << 22 else np.int64) << 9, f_size)
            key |= bwt[rows]
            del rows
            if (key[1:] < key[:-1]).any():
                by = np.argsort(key, kind="stable")
                key, to = key[by], to[by]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            new_lo.append(to[edge])
            new_hi.append(to[np.append(edge[1:], len(to)) - 1] + place(1))
        large = size > 256
        if large.any():
            l_lo, l_hi = lo[large], hi[large]
            for c in every.tolist():
                a = np.searchsorted(rows_of[c], l_lo) + starts[c]
                b = np.searchsorted(rows_of[c], l_hi) + starts[c]
                new_lo.append(a[b > a].astype(place))
                new_hi.append(b[b > a].astype(place))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]  # of one level, only one interval ends at a row
        unset[hi] = False
        if not len(lo):
            break
    long = np.zeros(n, bool)
    long[:-1] |= unset[1:n]
    long |= unset[:n]
    out = np.zeros(n, bool)
    out[order] = long
    return out


def repeats_in_block(contexts: list[bytes], times: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context: which of its windows start elsewhere, too; ``times`` is how often the context itself occurs."""
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16)
    joined[np.cumsum([len(c) + 1 for c in contexts]) - 1] = 256  # a border is no byte
    found = repeated_suffixes(joined, length)
    out, at = [], 0
    for context, n in zip(contexts, times):
        windows = len(context) - length + 1
        out.append(np.ones(windows, bool) if n > 1 else found[at : at + windows])
        at += len(context) + 1
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return edge[::2], edge[1::2]


_FOUND = ["uid", "begin", "end", "first", "high", "low"]


def _expand(length: int, block_bytes: int, hot: int, hot_bytes: int):
    """Found ranges (uid, begin, end: bytes covered) or, for hot keys, windows to be counted (uid, first, high, low).

    Rows come sorted by key and context, so that equal contexts are neighbours.
    """

    def ranges(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["uid", "begin", "end"]).reindex(columns=_FOUND)
        return out.astype({c: "Int64" for c in _FOUND})

    def settle(block: list[tuple[bytes, int, int, bool]]) -> list[tuple]:
        rows = []
        for flags, (_, uid, first, _) in zip(repeats_in_block([b[0] for b in block], [1 + b[3] for b in block], length), block):
            rows.extend((uid, first + int(a), first + int(b) - 1 + length) for a, b in zip(*_ranges(flags)))
        return rows

    def windows(stream: list[tuple[bytes, int, int, bool]]) -> pd.DataFrame:
        made = []
        for context, uid, first, _ in stream:
            d = np.frombuffer(b"".join(_digests(context, length)), np.int64).reshape(-1, 2)
            made.append((np.full(len(d), uid, np.int64), np.arange(first, first + len(d)), d[:, 0], d[:, 1]))
        u, f, h, w = (np.concatenate(x) for x in zip(*made))
        return pd.DataFrame({"uid": u, "begin": None, "end": None, "first": f, "high": h, "low": w}).astype({c: "Int64" for c in _FOUND})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple[bytes, int, int, bool]] = []
        own: list[tuple[bytes, int, int, bool]] = []  # of the key that is being read
        stream: list[tuple[bytes, int, int, bool]] = []  # of hot keys
        rows: list[tuple] = []  # settled
        held = own_bytes = stream_bytes = 0
        key, streaming = None, False
        window: tuple[bytes, int, int, bool] | None = None  # the last one told by its hash, and whether it is settled

        def close() -> None:
            """What is gathered of a key goes into the block, unless it is one repeated context."""
            nonlocal own, own_bytes, held
            if len(own) == 1 and own[0][3]:
                context, uid, first, _ = own[0]
                rows.append((uid, first, first + len(context)))
            else:
                block.extend(own)
                held += own_bytes
            own, own_bytes = [], 0

        for frame in frames:
            for k, uid, first, size, again, context in zip(*(frame[c] for c in ("key", "uid", "first", "size", "again", "context"))):
                if len(rows) > 50_000:
                    yield ranges(rows)
                    rows = []
                if stream_bytes > 300_000 and not streaming or stream_bytes > 2_000_000:
                    yield windows(stream)
                    stream, stream_bytes = [], 0
                if context is None:
                    rows.append((uid, first, first + size))
                    continue
                if size == length and len(context) == _DIGEST:
                    same = window is not None and window[0] == context
                    if same and not window[3]:
                        rows.append((window[1], window[2], window[2] + size))
                    if same or again:
                        rows.append((uid, first, first + size))
                    window = (context, uid, first, bool(same or again))
                    continue
                if k != key:
                    close()
                    key, streaming = k, False
                    if held > block_bytes:
                        rows.extend(settle(block))
                        block, held = [], 0
                context = bytes(context)
                into = stream if streaming else own
                if into and into[-1][0] == context:
                    rows.append((uid, first, first + size))
                    if not into[-1][3]:  # the one that goes on is marked
                        into[-1] = (*into[-1][:3], True)
                        if streaming:
                            rows.append((into[-1][1], into[-1][2], into[-1][2] + size))
                    continue
                into.append((context, uid, first, bool(again)))
                if streaming:
                    stream_bytes += size
                    if again:
                        rows.append((uid, first, first + size))
                    continue
                own_bytes += size + 1
                if len(own) > hot or own_bytes > hot_bytes:
                    streaming = True
                    rows.extend((u, f, f + len(c)) for c, u, f, a in own if a)
                    stream.extend(own)
                    stream_bytes += own_bytes
                    own, own_bytes = [], 0
        close()
        if block:
            rows.extend(settle(block))
        if rows:
            yield ranges(rows)
        if stream:
            yield windows(stream)

    return run


def _cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for sha, rid, text, spans in zip(frame["sha"], frame["rid"], frame["text"], frame["spans"]):
            data = text.encode("utf-8", "surrogatepass")
            merged = merge_spans([(s["begin"], s["end"]) for s in spans])
            kept = kept_parts(data, merged)
            whole = b"".join(kept)
            # part by part: halves of two characters must not make a third
            rows.append((sha, rid, len(data) - len(whole), len(merged), hashlib.sha256(whole).hexdigest(), "".join(x.decode("utf-8", "ignore") for x in kept)))
        yield pd.DataFrame(rows, columns=["sha", "rid", "n_removed", "n_spans", "kept_sha256", "kept"])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(int(a), int(b)) for a, b in out]


def kept_parts(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """What lies before, between and after the spans."""
    ends = [0, *(b for _, b in spans)]
    return [data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)])]


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(kept_parts(data, spans))


def _identity(text_col: str) -> tuple[Column, Column]:
    """SHA-256 of a text (null: empty) and its length in bytes."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.unhex(F.sha2(text, 256)), F.octet_length(text).cast("bigint")


def removals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, stretch: int = STRETCH,
    hot_owners: int = HOT_OWNERS, hot: int = HOT, hot_bytes: int = HOT_BYTES, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked, copies, changed): doc_id, n_bytes, sha and rid of every row; the shas of texts (of ``length`` bytes or more) that occur
    more than once; for each other row of which something goes, its sha, rid, n_removed, n_spans, kept_sha256 and kept.

    rid is a hash of id and text; beside the sha it spreads equal texts over the partitions.
    """
    small_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    sha, n_bytes = _identity(text_col)
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), sha.alias("sha"), n_bytes.alias("n_bytes"))
    base = base.select("*", F.xxhash64("doc_id", "sha").alias("rid"))
    texts = base.where(F.col("n_bytes") >= length)
    copies = cut(texts.groupBy("sha").agg(F.count("*").alias("copies"), F.min("rid").alias("rid")))
    anchors = texts.select(F.xxhash64("sha").alias("tkey"), "text").mapInPandas(lean(_anchors(length, stretch)), COMBINED)
    shared = cut(shared_keys(anchors))
    frequent = cut(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_owners).select("key", F.col("key").alias("hot")))
    shared = shared.withColumn("hot", F.lit(None).cast("bigint")) if at_most(frequent, 0) else shared.join(bounded(frequent), "key", "left")
    lists = shared.groupBy(F.col("owner").alias("tkey")).agg(F.collect_set("key").alias("shared"), F.collect_set("hot").alias("hot"))
    # the one row that stands for all copies of a text
    lists = lists.join(copies.withColumn("tkey", F.xxhash64("sha")), "tkey").select("sha", "rid", "shared", "hot", "copies")
    standing = texts.select("sha", "rid", "text").join(lists, ["sha", "rid"]).dropDuplicates(["sha", "rid"])
    standing = cut(standing.withColumn("uid", F.monotonically_increasing_id()))  # fixed by the checkpoint
    contexts = standing.select("uid", "text", "shared", "hot").mapInPandas(lean(_contexts(length, stretch)), _CONTEXTS)
    contexts = contexts.repartition(n, "key").sortWithinPartitions("key", "context")
    found = cut(contexts.mapInPandas(lean(_expand(length, block_bytes, hot, hot_bytes)), ", ".join(f"{c} bigint" for c in _FOUND)))
    counted = found.where("high is not null").groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low")
    more = found.where("high is not null").join(counted, ["high", "low"], "left_semi")
    spans = found.where("begin is not null").select("uid", "begin", "end").union(more.select("uid", F.col("first").alias("begin"), (F.col("first") + length).alias("end")))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    alone = standing.where("copies = 1").select("uid", "sha", "rid", "text").join(spans, "uid")
    changed = alone.select("sha", "rid", "text", "spans").mapInPandas(lean(_cut_out), "sha binary, rid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    return base.drop("text"), copies.where("copies > 1").select("sha"), changed


#: Places that the copies of one text are spread over when what is known of the text is joined to them.
SALTS = 16


def _known(copies: DataFrame, changed: DataFrame, columns: list[str]) -> DataFrame:
    """sha, salt, whole and ``columns`` of the texts that lose something: one join, and so one shuffle, serves both kinds."""
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    whole = copies.select("sha", salts.alias("salt"), F.lit(True).alias("whole"))
    part = changed.select("sha", _salt().alias("salt"), F.lit(False).alias("whole"), *columns)
    return whole.unionByName(part, allowMissingColumns=True)


def _salt() -> Column:
    return F.pmod("rid", F.lit(SALTS).cast("bigint"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans and kept_sha256. Of the texts, only those with repeats are shuffled after the search."""
    marked, copies, changed = removals(docs, id_col, text_col, length, **options)
    rows = marked.withColumn("salt", _salt()).join(_known(copies, changed, ["n_removed", "n_spans", "kept_sha256"]), ["sha", "salt"], "left")
    whole = F.coalesce("whole", F.lit(False))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of each text (and ``chars_col`` counted anew); all rows and columns kept.

    Where a cut leaves part of a character, that part goes, too.
    """
    _, copies, changed = removals(docs, id_col, text_col, length, **options)
    sha, _ = _identity(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), sha.alias("sha"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"))
    rows = rows.select("row", "sha", F.xxhash64("doc_id", "sha").alias("rid")).select("row", "sha", _salt().alias("salt"))
    rows = rows.join(_known(copies, changed, ["kept"]), ["sha", "salt"], "left")
    of = lambda c: F.col("row").getField(c)
    text = F.when(F.col("whole"), F.lit("")).otherwise(F.coalesce("kept", of(text_col)))
    new = {text_col: text, chars_col: F.length(text).cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None}
    return rows.select(*[new.get(c, of(c)).alias(c) for c in docs.columns])
