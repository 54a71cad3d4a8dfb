"""Quotation linking: chats without quotes, in reply order.

The lines of a message have a quote level, the count of '>' before them. Neighbouring lines of one level are
a passage, joined with single spaces, so that it does not matter where its lines end. Each sentence of a quoted passage is
normalised and hashed and joined to the sentences that earlier messages of the same conversation said themselves; a
sentence that none said as a whole is linked by its lines and windows of ``WINDOW`` words, if the message said at
least half of them. A message replies to the one from which most of its quoted characters of level 1 come.
Messages lose the quoted passages of which a sentence is linked (what is left out is said elsewhere) and are placed so that each
follows the one it replies to.

Defined results: a null or empty text is a message without words and without quotes; a quoted passage that
no earlier message said stays in the text as it was written, marks included; if several earlier
messages said a sentence, the latest counts; less than ``WINDOW`` words out of the middle of a sentence stay unlinked; equal counts go to the later message. A null conv_id or turn
joins with nothing, so that such a message keeps its text. Repeated rows stay repeated. No row is dropped. A very long message is one row, its
pieces are rows. An empty table gives an empty table. Other columns don't matter, whatever their names, and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

_LEVEL = re.compile(r"\s{0,3}((?:>\s?)+)")
_ATTRIBUTION = re.compile(r"(wrote|writes|said|a écrit|schrieb|escribió)\s*:\s*$", re.I)
_SPACES = re.compile(r"\s+")
_END = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
_PARTS = "array<struct<level:int,unit:bigint,n_chars:int,parts:array<bigint>>>"
_NO_CONV = object()
#: Words of a window: quoted ones lie side by side, said ones begin at each word.
WINDOW = 5


def normalise(line: str) -> str:
    """Lower case, single spaces, without marks at the ends."""
    return _SPACES.sub(" ", line).strip(" \t.,;:!?*_~\"'…-").lower()


def parse_levels(text: str | None) -> list[tuple[int, str]]:
    """(level, line without its marks) of each line; level 0 is the message's own."""
    lines = []
    for line in (text or "").splitlines():
        m = _LEVEL.match(line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return lines


def _runs(lines: list[tuple[int, str]]) -> list[tuple[int, list[int]]]:
    """(level, the places of its lines) of each run of lines of one level; empty lines end a run."""
    found: list[tuple[int, list[int]]] = []
    last = None
    for k, (level, line) in enumerate(lines):
        if line.strip():
            if level != last:
                found.append((level, []))
            found[-1][1].append(k)
        last = level if line.strip() else None
    return found


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """(level, its lines) of each passage."""
    return [(level, [lines[k][1] for k in at]) for level, at in _runs(lines)]


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _words(text: str) -> list[str]:
    return [w for x in text.split() if (w := normalise(x))]


def _windows(words: list[str], step: int) -> list[int]:
    """Hashes of the windows that begin at every ``step``-th word, and of the last one."""
    if len(words) < WINDOW:
        return []
    starts = {*range(0, len(words) - WINDOW + 1, step), len(words) - WINDOW}
    return [_hash("\n".join(words[k : k + WINDOW])) for k in sorted(starts)]


def _sentences(lines: list[str]) -> list[str]:
    return [n for x in _END.split(" ".join(x.strip() for x in lines)) if (n := normalise(x))]


def said_pieces(own: str | None) -> list[int]:
    """Hashes of the sentences, lines and word windows of a message's own text."""
    found = set()
    for _, lines in passages([(0, x) for x in (own or "").splitlines()]):
        found.update(_hash(x) for x in _sentences(lines))
        found.update(_hash(n) for x in lines if (n := normalise(x)))
        found.update(_windows(_words(" ".join(lines)), 1))
    return sorted(found)


def quoted_units(level: int, lines: list[str]) -> list[tuple[int, int, int, list[int]]]:
    """(level, hash, characters, hashes of its parts) of each sentence of a quoted passage.

    Parts are the lines that lie wholly in it, if there are several, and its word windows.
    """
    whole = [n for x in lines if (n := normalise(x))]
    found = []
    for unit in _sentences(lines):
        parts = [_hash(x) for x in whole if len(whole) > 1 and x in unit] + _windows(_words(unit), WINDOW)
        found.append((level, _hash(unit), len(unit), sorted(set(parts))))
    return found


def _read(text: str | None) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """The lines with their levels, "... wrote:" before a quote emptied, and for each such line the place of the quote's first line."""
    lines = parse_levels(text)
    kept, leads = [], {}
    for k, (level, line) in enumerate(lines):
        if _ATTRIBUTION.search(line):
            after = next((j for j in range(k + 1, len(lines)) if lines[j][1].strip()), None)
            if after is not None and lines[after][0] > level:
                leads[k] = after
        kept.append((level, "" if k in leads else line))
    return kept, leads


def split_message(text: str | None) -> tuple[str, list[tuple[int, int, int, list[int]]]]:
    """What a message says itself, without any quote, and the sentences it quotes."""
    kept, leads = _read(text)
    units = {u[:2]: u for level, run in passages(kept) if level for u in quoted_units(level, run)}
    if not any(level and normalise(line) for level, line in kept):
        return text or "", list(units.values())
    return _joined([line for k, (level, line) in enumerate(kept) if not level and k not in leads]), list(units.values())


def without_linked(text: str | None, linked: set[tuple[int, int]]) -> str:
    """The message without the quoted passages of which a sentence (level, hash) is linked, and without what leads to them."""
    if not linked:
        return text or ""
    kept, leads = _read(text)
    gone = set()
    for level, at in _runs(kept):
        if level and any(u[:2] in linked for u in quoted_units(level, [kept[k][1] for k in at])):
            gone.update(at)
    raw = (text or "").splitlines()
    empty = {k for k, (level, line) in enumerate(kept) if level and not line.strip() and k not in leads}
    return _joined([x for k, x in enumerate(raw) if k not in gone and k not in empty and leads.get(k) not in gone])


def _joined(lines: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def _quoted(column: str) -> Column:
    @F.pandas_udf(_PARTS)
    def quoted(texts: pd.Series) -> pd.Series:
        names = ("level", "unit", "n_chars", "parts")
        return pd.Series([[dict(zip(names, u)) for u in split_message(t)[1]] for t in texts])

    return quoted(column)


def _said(column: str) -> Column:
    @F.pandas_udf("array<bigint>")
    def said(texts: pd.Series) -> pd.Series:
        return pd.Series([said_pieces(split_message(t)[0]) for t in texts])

    return said(column)


def _own(text: str, linked: str) -> Column:
    @F.pandas_udf("string")
    def own(texts: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([without_linked(t, {(int(u["level"]), int(u["line_hash"])) for u in ([] if x is None else x)}) for t, x in zip(texts, links)], dtype=object)

    return own(text, linked)


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, line_hash, n_chars, source_turn): each quoted sentence with the turn it comes from, null if none."""
    return _links(cut(messages.select("conv_id", "turn", "text", _quoted("text").alias("quoted"))))


def _links(parsed: DataFrame) -> DataFrame:
    # a row number, as equal rows stay apart
    quotes = cut(
        parsed.where("size(quoted) > 0")
        .withColumn("row", F.monotonically_increasing_id())
        .select("conv_id", "turn", "row", F.explode("quoted").alias("q"))
        .select("conv_id", "turn", "row", F.col("q.level").alias("level"), F.col("q.unit").alias("line_hash"), F.col("q.n_chars").alias("n_chars"), "q.parts")
    )
    unit = ["conv_id", "turn", "row", "level", "line_hash", "n_chars"]
    keys = quotes.select(*unit, F.size("parts").alias("n_parts"), F.explode(F.concat(F.array("line_hash"), "parts")).alias("key"))
    keys = keys.withColumn("exact", F.col("key") == F.col("line_hash"))
    wanted = keys.select("conv_id", "key").distinct()
    quoting = quotes.select("conv_id").distinct()
    said = parsed.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.explode(_said("text")).alias("key"))
    # one row a piece and turn, then the latest earlier turn by a running maximum: linear, whatever the repeats
    said = said.join(wanted, ["conv_id", "key"], "left_semi").distinct()
    both = keys.unionByName(said, allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    traced = both.withColumn("source_turn", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(earlier)).where("level is not null")
    votes = traced.groupBy(*unit, "n_parts", "exact", "source_turn").agg(F.count("*").alias("n"))
    fits = F.col("source_turn").isNotNull() & (F.col("exact") | (2 * F.col("n") >= F.col("n_parts")))
    best = votes.groupBy(*unit).agg(F.max(F.when(fits, F.struct("exact", "n", "source_turn")))["source_turn"].alias("source_turn"))
    return best.select("conv_id", "turn", "level", "line_hash", "n_chars", "source_turn")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, text without linked quotes, parent_turn, root_turn, depth, reply_pos, n_quotes, n_linked.

    reply_pos numbers the messages of a conversation from 0: threads by the turn of their first
    message, within a thread by depth and turn, so that each message follows the one it replies to.
    """
    parsed = cut(messages.select("conv_id", "turn", "role", "text", _quoted("text").alias("quoted")))
    links = _links(parsed)
    counted = links.groupBy("conv_id", "turn", "source_turn").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("n_chars")).otherwise(0)).alias("c"),
        F.collect_set(F.when(F.col("source_turn").isNotNull(), F.struct("level", "line_hash"))).alias("u"),
    )
    replies = cut(
        counted.groupBy("conv_id", "turn").agg(
            F.sum("n").alias("n_quotes"),
            F.sum(F.when(F.col("source_turn").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
            F.max(F.when(F.col("source_turn").isNotNull(), F.struct("c", "source_turn")))["source_turn"].alias("parent_turn"),
            F.flatten(F.collect_list("u")).alias("linked"),
        )
    )
    # pointer doubling over the messages that reply: up is the ancestor reached, depth the steps to it
    ways = replies.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth"))
    ways = cut(ways)
    while True:
        ahead = ways.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        ways = cut(
            ways.join(ahead, ["conv_id", "up"], "left").select(
                "conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")
            )
        )
        if ways.where("moved").limit(1).count() == 0:
            break
    known = replies.join(ways.select("conv_id", "turn", "up", "depth"), ["conv_id", "turn"], "left")
    out = parsed.select("conv_id", "turn", "role", "text").join(known, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", "turn", "role", _own("text", "linked").alias("text"), "parent_turn",
        F.coalesce("up", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )
    return _numbered(out)


def _numbered(messages: DataFrame) -> DataFrame:
    """``messages`` with reply_pos. They are put in order over ranges, so that a large conversation goes over many tasks; a conversation's
    messages in earlier ranges are added to its places in a range (a range begins with at most one conversation that began before)."""
    n = partitions(messages.sparkSession)
    order = ["conv_id", "root_turn", "depth", "turn", "role", "h"]
    ranged = messages.withColumn("h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("h")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, pid = _NO_CONV, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("conv_id").to_pylist()
            change = np.array([k == 0 or a != b for k, (a, b) in enumerate(zip(key, [None, *key[:-1]]))])
            run = np.cumsum(change)
            place = np.arange(len(key)) - np.flatnonzero(change)[run - 1]
            if conv is not _NO_CONV and key[0] == conv:
                place[run == 1] += seen
            conv, seen = key[-1], int(place[-1]) + 1
            extra = [pa.array(np.full(len(key), pid, np.int32)), pa.array(place.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "pid", "reply_pos"])

    placed = cut(ranged.mapInArrow(local, f"{schema}, pid int, reply_pos bigint"))
    counts = placed.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    spread = counts.withColumn("pids", F.count("*").over(Window.partitionBy("conv_id"))).where("pids > 1")
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row a range
    starts = spread.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), F.sum("n").over(before).alias("before")).where("before is not null")
    out = placed.join(F.broadcast(starts), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")), "left")
    return out.withColumn("reply_pos", F.col("reply_pos") + F.coalesce("before", F.lit(0))).drop("c", "p", "before", "pid")


def conversations(ordered: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and its messages (role, text) in reply order."""
    at = F.struct("reply_pos", "turn", "role", "text")
    rows = ordered.groupBy("conv_id").agg(F.sort_array(F.collect_list(at)).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
