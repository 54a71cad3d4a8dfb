"""N-gram Jaccard join: grouped prefix join with verification.

Every document is a set of word shingles (64-bit hashes). Documents of equal sets are one class.

1. Screening. By the length-l prefix principle, under any one order of all shingles, two sets that
   link share at least l of their prefixes of |A| - ceil(t |A|) + l shingles. With hashes as the order
   and l about ``EXTRA`` percent of the set, a class of which fewer prefix shingles occur in another class
   can't link, and leaves. Most documents do; a second round tries the rest by longer prefixes.
2. Grouped prefix join. Of the classes left, shingles are ordered by how many classes have them, rare
   ones first. Classes with identical prefixes and size are one group. Groups that share a prefix shingle
   are candidates; candidates are held as stars (a shingle's groups all point to the least of them), so
   that their number is linear in the prefixes, whatever the frequency of a shingle.
3. Verification. The connected candidates make a cluster, which is cut into blocks of bounded size; in
   a block, group pairs pass the size and prefix filters, then members are verified by the exact
   Jaccard of their sets, unless they are known to be connected. Large clusters: every block also has
   the cluster's hubs; what the blocks leave unconnected to the largest part is then verified against
   all other blocks, pair by pair of blocks. All links between different parts are found.

The components of the links are those of the full join: a link is skipped only if its ends are
connected already.

Defined results: null texts and texts without words have size 0 and link with nothing; texts of fewer
words than a shingle has are one shingle, the whole sequence; very long texts are hashed piece by piece; repeated rows are of one class; rows
without a doc_id link like others, but a null never becomes a component's id unless all its rows lack one (the id is null, then);
empty tables give empty tables. Other columns don't matter, whatever their names: ``jaccard_classes`` leaves them out, ``keep_one_each`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import COMBINED, FLUSH_ROWS, at_most, bounded, combined, cut, grouped_frames, lean, partitions, shared_keys, shingle_set, small_batches
from .components import connected_components

#: Percent of a set that the screening prefixes have beyond what a plain prefix has, in the two rounds.
EXTRA, EXTRA_AGAIN = 10, 30
#: Classes in a block.
BLOCK = 400
HUBS = 4


def _needed(size: int, percent: int) -> int:
    """ceil(percent / 100 * size), in whole numbers."""
    return -(-size * percent // 100)


def screen_length(size: int, percent: int, extra: int) -> int:
    """Length of the screening prefix of a set of this size."""
    return min(size, size - _needed(size, percent) + extra * size // 100 + 1)


def _least(percent: int, extra: int) -> str:
    """SQL: how many of its screening prefix a set of n_shingles must share at least to link with anything."""
    return f"({extra} * ((n_shingles * {percent} + 99) div 100) div 100 + 1)"


def _class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    """Eight bytes of a class: keys of tables; where two classes share them, more is let through, nothing is lost."""
    return int.from_bytes(key[:8], "big", signed=True)


def _features(words: int):
    """(doc_id, n_shingles, class, rk) of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, rk in zip(frame["doc_id"], frame["text"], frame["rk"]):
                s = shingle_set(text, words)
                rows.append((doc_id, len(s), _class_of(s) if len(s) else None, rk))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "class", "rk"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _screening(sets_of, percent: int, extra: int):
    """Screening prefixes as rows for ``shared_keys``; ``sets_of`` gives the sets of a frame. A class counts once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple] = []
        held, seen = 0, set()
        for frame in frames:
            for s in sets_of(frame):
                if not len(s) or (c := _short(_class_of(s))) in seen:
                    continue
                seen.add(c)
                p = s[: screen_length(len(s), percent, extra)].copy()  # the rest of the set is not held
                parts.append((p, np.full(len(p), c, np.int64), np.zeros(len(p), bool)))
                held += len(p)
                if held > FLUSH_ROWS:
                    yield from combined(parts)
                    parts, held, seen = [], 0, set()
        if parts:
            yield from combined(parts)

    return run


def _passed(rows: DataFrame, classes: DataFrame, percent: int, extra: int) -> DataFrame:
    """The classes (c, class, n_shingles, doc_id, copies) that share enough of their screening prefix."""
    counted = shared_keys(rows).groupBy(F.col("owner").alias("c")).agg(F.count("*").alias("n"))
    return cut(classes.join(counted, "c").where(f"n >= {_least(percent, extra)}").drop("n"))


def _sets(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in zip(frame["class"], frame["text"]):
                s = shingle_set(text, words)
                if _class_of(s) == bytes(key):
                    rows.append((key, len(s), s.view(np.int64)))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=["class", "size", "tokens"])
                    rows = []
            yield pd.DataFrame(rows, columns=["class", "size", "tokens"])

    return run


class _Parts:
    """Union-find over the members of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def verify_block(sizes: list[int], groups: list, prefixes: list[np.ndarray], sets: list[np.ndarray], sides: list[int], known: list, percent: int) -> list[tuple[int, int]]:
    """Links (pairs of positions) that connect all that is connected in a block.

    ``groups`` numbers members of identical prefix and size alike. ``sides``: members of sides 0 and 1 are
    compared with each other only; side 2 with everyone. ``known``: members of equal known value are connected already.
    """
    parts, links = _Parts(len(sizes)), []
    first: dict = {}
    for k, v in enumerate(known):
        if v is not None:
            if v in first:
                parts.join(first[v], k)
            first.setdefault(v, k)

    def met(a: int, b: int) -> bool:
        return sides[a] == 2 or sides[b] == 2 or sides[a] != sides[b]

    def test(a: int, b: int) -> None:
        if not met(a, b) or parts.root(a) == parts.root(b):
            return
        small, large = sorted((sizes[a], sizes[b]))
        if small * 100 < large * percent:
            return
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if common * 100 >= percent * (small + large - common):
            parts.join(a, b)
            links.append((a, b))

    members: dict = {}
    for k, g in enumerate(groups):
        members.setdefault(g, []).append(k)
    order = sorted(members, key=lambda g: (sizes[members[g][0]], members[g][0]))
    for g in order:  # within a group
        own = members[g]
        for k in own[1:]:
            test(own[0], k)
        if len(own) > 2 and len({parts.root(k) for k in own}) > 1:
            for a, b in combinations(own[1:], 2):
                test(a, b)
    index: dict[int, list] = {}
    for g in order:  # against groups of the same size or smaller that share a prefix shingle
        seen: set = set()
        own = members[g]
        size = sizes[own[0]]
        for token in prefixes[own[0]].tolist():
            for other in index.get(token, ()):
                if other in seen:
                    continue
                seen.add(other)
                theirs = members[other]
                if sizes[theirs[0]] * 100 < size * percent:
                    continue
                for a in own:
                    for b in theirs:
                        test(a, b)
            index.setdefault(token, []).append(g)
    return links


def _verify(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped_frames(frames, ["block"], 2_000):
            for _, part in frame.groupby("block", sort=False):
                part = part.sort_values("class", kind="stable").drop_duplicates("class")
                if len(part) < 2:
                    continue
                sets = [np.asarray(x) for x in part["tokens"]]
                prefixes = [np.asarray(x) for x in part["prefix"]]
                groups = [(s, p.tobytes()) for s, p in zip(part["size"], prefixes)]
                known = [None if x is None or (isinstance(x, float)) else bytes(x) for x in part["known"]]
                links = verify_block(part["size"].tolist(), groups, prefixes, sets, part["side"].tolist(), known, percent)
                if links:
                    keys = part["class"].tolist()
                    yield pd.DataFrame({"a": [keys[a] for a, _ in links], "b": [keys[b] for _, b in links]})

    return run


def _run_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks; rows: block, side, known, class, size, prefix, tokens."""
    ordered = rows.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block")
    return cut(ordered.mapInPandas(lean(_verify(percent)), "a binary, b binary"))


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_shingles, class (of equal sets, null if empty), component_id.

    ``words`` a shingle; documents link at a Jaccard similarity of ``percent`` hundredths or more.
    component_id is the least doc_id reachable by links, the document's own if there are none.
    """
    return _labelled(docs, words, percent, id_col, text_col, block).select("doc_id", "n_shingles", "class", "component_id")


def _row_key(id_col: str, text_col: str) -> Column:
    """Of id and text. A set is fetched from the row of its class that has the least; rows that only share the key are told apart by their sets."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"`{text_col}`")))


def _labelled(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """What ``jaccard_classes`` gives, with rk and the component's label."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), _row_key(id_col, text_col).alias("rk"))
    features = cut(slim.mapInPandas(lean(_features(words)), "doc_id bigint, n_shingles bigint, class binary, rk bigint"))
    short = F.expr("cast(conv(hex(substring(class, 1, 8)), 16, -10) as bigint)")
    classes = features.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"), F.min("rk").alias("rk"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("c", short))

    # 1. two rounds of screening: all documents by a short prefix, then the classes left by a long one
    prefixes = slim.select("text").mapInPandas(lean(_screening(lambda f: (shingle_set(t, words) for t in f["text"]), percent, EXTRA)), COMBINED)
    alive = _passed(prefixes, classes, percent, EXTRA)
    texts = slim.select("rk", "text").join(bounded(alive.select("rk", "class")), "rk").select("class", "text")
    sets = cut(texts.mapInPandas(lean(_sets(words)), "class binary, size bigint, tokens array<bigint>"))
    if sets.count() > alive.count():  # only if rows repeat id and text
        sets = cut(sets.dropDuplicates(["class"]))
    prefixes = sets.select("tokens").mapInPandas(lean(_screening(lambda f: (np.asarray(t, np.int64).view(np.uint64) for t in f["tokens"]), percent, EXTRA_AGAIN)), COMBINED)
    alive = _passed(prefixes, alive, percent, EXTRA_AGAIN)

    # 2. order by frequency among the classes left; prefixes; groups of identical prefix and size
    left = sets.join(bounded(alive.select("class", "c", "copies")), "class")
    each = left.select("c", F.explode_outer("tokens").alias("token"))
    # a shingle that only one class has comes before all others and leads nowhere: only the number of these matters
    frequency = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    ordered = each.join(frequency, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("o"))
    ordered = ordered.join(alive.select("c", F.col("n_shingles").alias("size")), "c")
    length = f"cast(greatest(0, size - (size * {percent} + 99) div 100 + 1 - (size - size(o))) as int)"
    prefixes = ordered.select("c", "size", F.expr(f"transform(slice(o, 1, {length}), x -> x.token)").alias("prefix")).where(F.size("prefix") > 0)
    prefixes = cut(prefixes)
    of_groups = cut(prefixes.groupBy("size", "prefix").agg(F.min("c").alias("g")))
    spread = of_groups.select("g", F.explode_outer("prefix").alias("token"))
    least = spread.groupBy("token").agg(F.min("g").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = spread.join(least, "token").where("g <> least").select(F.col("g").alias("a"), F.col("least").alias("b")).distinct()
    clusters = connected_components(stars)
    member = prefixes.join(of_groups, ["size", "prefix"]).join(clusters, F.col("g") == F.col("node"), "left")
    member = member.select("c", "size", "prefix", F.coalesce("label", "g").alias("cluster"))
    counted = cut(member.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1"))
    member = cut(member.join(counted, "cluster"))

    # 3. blocks
    work = (
        left.select("class", "c", "copies", "tokens").join(bounded(member), "c")
        .withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(3)), F.ceil(F.col("n") / block)))
        .select("cluster", "n", "chunk", "class", "copies", "size", "prefix", "tokens")
    )
    large = not at_most(counted.where(F.col("n") > block), 0)
    if large:
        work = cut(work)
    small = work.select(F.concat_ws("/", "cluster", "chunk").alias("block"), F.lit(2).alias("side"), F.lit(None).cast("binary").alias("known"), "class", "size", "prefix", "tokens")
    if large:
        big = work.where(F.col("n") > block).select("cluster", "n", "class", "copies")
        # every block of a large cluster gets the cluster's hubs: its classes of most copies, and some at random
        hubs = big.groupBy("cluster", "n").agg(
            F.max_by("class", F.struct("copies", "class")).alias("h0"),
            *[F.min_by("class", F.xxhash64("class", F.lit(100 + k))).alias(f"h{k}") for k in range(1, HUBS)],
        )
        hubs = hubs.select("cluster", "n", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HUBS)]))).alias("class"))
        hubs = hubs.join(work.select("cluster", "class", "size", "prefix", "tokens"), ["cluster", "class"])
        hubs = hubs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / block) - 1)))
        small = small.unionByName(hubs.select(F.concat_ws("/", "cluster", "chunk").alias("block"), F.lit(2).alias("side"), F.lit(None).cast("binary").alias("known"), "class", "size", "prefix", "tokens"))
    links = _run_blocks(small, percent)
    if large:
        links = links.unionByName(_across(work, big, links, percent, block))
    labels = connected_components(links)
    classes = classes.join(labels, F.col("class") == F.col("node"), "left").select("class", "doc_id", F.coalesce("label", "class").alias("label"))
    ids = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = classes.join(ids, "label").select("class", "label", "component_id")
    joined = features.join(placed, "class", "left")
    return joined.select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"), "label", "rk")


def _across(work: DataFrame, big: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between parts of large clusters that no block had together.

    Within a cluster, the largest part that the blocks have found needs no comparing with itself: what
    is outside of it (side 0) is compared with all of the cluster (side 1), block by block.
    """
    labels = connected_components(links)
    parts = big.join(labels, F.col("class") == F.col("node"), "left").select("cluster", "n", "class", F.coalesce("label", "class").alias("known"))
    parts = cut(parts)
    largest = parts.groupBy("cluster", "known").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("known", F.struct("k", "known")).alias("main"))
    parts = parts.join(largest, "cluster")
    rows = parts.join(work.select("class", "size", "prefix", "tokens"), "class")
    blocks = F.ceil(F.col("n") / block)
    # outsiders against the main part: rows of either side are repeated once for each block of the other
    outside = rows.where("known <> main")
    count = outside.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("m"))
    outside = outside.join(count, "cluster").withColumn("i", F.pmod(F.xxhash64("class", F.lit(5)), F.col("m"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    inside = rows.where("known = main").join(count, "cluster").withColumn("j", F.pmod(F.xxhash64("class", F.lit(7)), blocks)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    cols = [F.concat_ws("/", "cluster", "i", "j").alias("block"), "side", "known", "class", "size", "prefix", "tokens"]
    both = outside.withColumn("side", F.lit(0)).select(*cols).unionByName(inside.withColumn("side", F.lit(1)).select(*cols))
    # outsiders among themselves: every pair of their blocks
    pairs = rows.where("known <> main").join(count, "cluster").withColumn("i", F.pmod(F.xxhash64("class", F.lit(5)), F.col("m"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    pairs = pairs.withColumn("side", F.lit(2)).select(F.concat_ws("/", "cluster", F.lit("o"), F.least("i", "j"), F.greatest("i", "j")).alias("block"), *cols[1:])
    return _run_blocks(both.unionByName(pairs), percent)


def keep_one_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of the least id. Repeated rows of it count as one.

    Of a component whose rows all lack an id, one row stays. Documents without words are all kept, as they link with nothing.
    """
    found = cut(_labelled(docs, words, percent, id_col, text_col, BLOCK).where("class is not null").select("doc_id", "component_id", "label", "rk"))
    # rows without the component's id go; of those with it (one, unless rows repeat their id or all lack one) one stays
    heads = found.where("doc_id <=> component_id").select("label", "rk")
    more = heads.join(heads.groupBy("label").agg(F.min("rk").alias("keep")), "label").where("rk <> keep").select("rk")
    gone = cut(found.where("not (doc_id <=> component_id)").select("rk").unionByName(more).distinct())
    again = cut(found.groupBy("rk").agg(F.count("*").alias("n")).where("n > 1").select("rk"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(F.col(f"`{text_col}`").isNotNull(), _row_key(id_col, text_col)).alias("rk"))
    rows = rows.join(bounded(gone), "rk", "left_anti")
    if not at_most(again, 0):
        repeated = bounded(again)
        rows = rows.join(repeated, "rk", "left_anti").unionByName(rows.join(repeated, "rk", "left_semi").dropDuplicates(["rk"]))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), i as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from w where len(w) > 0
), s as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as sh from i
), n as (
  select doc_id, count(*) as n from s group by doc_id
), b as (
  select a.doc_id as x, c.doc_id as y, count(*) as k from s a join s c on a.sh = c.sh and a.doc_id < c.doc_id group by 1, 2
), l as (
  select x, y from b join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 90 * (p.n + q.n - k)
), e as (
  select x, y from l union select y, x from l
), r as (
  select doc_id as d, doc_id as o from w
  union
  select r.d, e.y from r join e on e.x = r.o
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from w left join n on n.doc_id = w.doc_id join (select d, min(o) as component_id from r group by d) m on m.d = w.doc_id
"""
