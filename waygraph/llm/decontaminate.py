"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Items and documents are sets of five-word shingles (lower case, words of letters and digits); fewer words are one
shingle, the whole sequence. An item of q shingles counts as contained if at least ``share`` percent of them, rounded up (need), are in the document.

1. Size partitions. Document rows are partitioned by the power of two of their number of shingles. An item is searched for in
   the partitions whose largest size reaches its need, and in no others.
2. MinHash sketches, under one hash order. An item's sketch is the q - need + 1 least hashes of its shingles: a document that
   contains it lacks at most q - need of its shingles, so it has one of the sketch for certain. The sketch of a document in a partition is
   all of its hashes up to the largest in the sketches of the partition's items (a bottom sketch by threshold: of long documents
   it grows with their length, as it must for short items to be found in them). Sketches that share a hash make a candidate.
3. Verification by exact containment of the shingles as text.

So no true pair is lost, whatever the lengths. Banded signatures of fixed length, tuned a partition, would lose short items:
an item of 20 shingles in a document of 20,000 has a Jaccard similarity of 0.001, so that most bands see nothing of it.

Defined results: null texts and texts without words have no shingles and neither contain nor are
contained; repeated shingles count once; rows that share a doc_id count as one document (they are searched as if they were of
the largest size) and rows that share an item_id as one item; rows without an id are not reported; very long texts are rows like others;
an empty table gives no pairs; other columns don't matter, whatever their names, and ``decontaminate`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, bounded, cut

WORDS, SHARE = 5, 80  # shingle length; percent of an item's shingles
NON_WORD = r"[^\p{L}\p{N}]+"


def _shingled(df: DataFrame, id_col: str, text_col: str, as_text: bool, keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., n, sh): sh holds the n shingles of a row, as hashes or as text; null for a row without words.

    Each step is a select of its own: arrays that a step uses more than once are then made once.
    Use explode_outer on sh: for explode the optimiser would infer a filter on the array's size and
    push it down, making the arrays twice. Shingles grow from single words by pairing shifted arrays, in time linear in the words.
    """
    keep = keep or []
    join = (lambda a, b: F.concat_ws(" ", a, b)) if as_text else (lambda a, b: F.xxhash64(a, b))
    out = df.select(F.col(f"`{id_col}`").alias("id"), *keep, F.split(F.lower(F.col(f"`{text_col}`")), NON_WORD).alias("w"))
    # a text that starts or ends with no word has an empty part there, and only there
    first = F.when(F.get("w", F.lit(0)) == "", 2).otherwise(1)
    size = F.size("w") - first + 1 - F.when(F.element_at("w", -1) == "", 1).otherwise(0)
    out = out.select("id", *keep, F.slice("w", first, F.greatest(size, F.lit(0))).alias("w"))
    out = out.select("id", *keep, "w", F.size("w").alias("n"))
    upto = lambda k: F.greatest(F.col("n") - k, F.lit(0))
    two = F.zip_with(F.slice("w", 1, upto(1)), F.slice("w", 2, upto(1)), join)
    out = out.select("id", *keep, "w", "n", two.alias("w2"))
    four = F.zip_with(F.slice("w2", 1, upto(3)), F.slice("w2", 3, upto(3)), join)
    out = out.select("id", *keep, "w", "n", four.alias("w4"))
    five = F.zip_with(F.slice("w4", 1, upto(4)), F.slice("w", 5, upto(4)), join)
    whole = F.concat_ws(" ", "w") if as_text else F.xxhash64(F.concat_ws(" ", "w"))
    sh = F.when(F.col("n") >= WORDS, five).when(F.col("n") > 0, F.array(whole))
    return out.select("id", *keep, F.greatest(F.col("n") - WORDS + 1, F.lit(1)).alias("n"), sh.alias("sh"))


#: The number of size partitions; the last one has all rows from 2 ** (PARTITIONS - 1) shingles on.
PARTITIONS = 31
_LEAST = -(1 << 63)


def _partition(size: str) -> str:
    """SQL: the size partition of a row, or the least partition that reaches an item's need."""
    return f"least(cast(floor(log2({size})) as int), {PARTITIONS - 1})"


def _probes(docs: DataFrame, id_col: str, text_col: str, limits: list[int]) -> DataFrame:
    """(id, part, h): the sketches of document rows; limits: the largest hash that counts in each partition."""
    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    ids = known.select(F.col(f"`{id_col}`").alias("id"))
    again = cut(ids.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1"))
    rows = known.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if at_most(again, 0):
        rows = rows.select("*", F.lit(1).cast("bigint").alias("rows"))
    else:
        rows = rows.join(bounded(again), "id", "left")
    # the partition from the words, not from the array: nothing here may make the shingles twice
    sketched = _shingled(rows, "id", "text", as_text=False, keep=["rows"])
    sketched = sketched.select("id", F.when(F.coalesce("rows", F.lit(1)) > 1, PARTITIONS - 1).otherwise(F.expr(_partition("n"))).alias("part"), "sh")
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("part") + 1)
    sketched = sketched.select("id", "part", limit.alias("limit"), "sh").select("id", "part", F.filter("sh", lambda h: h <= F.col("limit")).alias("sh"))
    return sketched.select("id", "part", F.explode_outer("sh").alias("h"))


def find_contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: int = SHARE
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment): every pair at or above ``share`` percent.

    The sketches of documents are never shuffled while those of the items are small enough to
    broadcast (counted first); otherwise they are joined by hash, skew left to adaptive execution.
    """
    items = items.where(F.col(f"`{item_id_col}`").isNotNull())
    own = _shingled(items, item_id_col, item_text_col, as_text=True).select("id", F.explode_outer("sh").alias("sh")).where("sh is not null").distinct()
    sizes = own.groupBy("id").agg(F.count("*").alias("q")).withColumn("need", F.expr(f"(q * {share} + 99) div 100"))
    own = cut(own.join(sizes, "id"))
    hashed = _shingled(items, item_id_col, item_text_col, as_text=False).select("id", F.explode_outer("sh").alias("h")).where("h is not null").distinct()
    sketch = hashed.groupBy("id").agg(F.sort_array(F.collect_list("h")).alias("h")).join(sizes, "id")
    sketch = sketch.select("id", F.expr(_partition("need")).alias("least"), F.explode(F.expr("slice(h, 1, cast(q - need + 1 as int))")).alias("h"))
    sketch = cut(sketch.select(F.col("id").alias("item_id"), "least", "h"))

    # search: an item's sketch meets the sketches of the partitions that can hold it
    tops = {r.least: r.top for r in sketch.groupBy("least").agg(F.max("h").alias("top")).collect()}  # a row a partition at most
    limits = [max([_LEAST, *(t for k, t in tops.items() if k <= part)]) for part in range(PARTITIONS)]
    found = _probes(docs, id_col, text_col, limits).join(bounded(sketch), "h").where("coalesce(part, -1) >= least")
    candidates = cut(found.select(F.col("id").alias("doc_id"), "item_id").distinct())

    # verification: the shingles as text, of candidate documents only
    wanted = cut(candidates.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = slim.join(bounded(wanted, 20_000), "doc_id")
    shingles = _shingled(texts, "doc_id", "text", as_text=True, keep=["items"])
    shingles = shingles.select(F.col("id").alias("doc_id"), "items", F.explode_outer("sh").alias("sh"))
    matched = shingles.join(bounded(own), "sh").where(F.array_contains("items", F.col("id")))
    counted = matched.groupBy("doc_id", F.col("id").alias("item_id"), F.col("q").alias("n_item_shingles"), "need").agg(F.count_distinct("sh").alias("n_shared"))
    return counted.where("n_shared >= need").select(
        "doc_id", "item_id", "n_item_shingles", "n_shared", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns and rows without an id kept."""
    hit = cut(find_contained(docs, items, id_col, text_col, **options).select("doc_id").distinct())
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"))
    return own.join(bounded(hit), "doc_id", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
with w as (
  select doc_id as id, 0 as kind, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
  union all
  select item_id, 1, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') from benchmark
), n as (
  select id, kind, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0 and id is not null
), s as (
  select distinct id, kind, array_to_string(w[i : i + 4], ' ') as sh from n
), q as (
  select id, count(*) as q from s where kind = 1 group by id
), m as (
  select d.id as doc_id, b.id as item_id, count(*) as n_shared from s d join s b on d.sh = b.sh and d.kind = 0 and b.kind = 1 group by 1, 2
)
select doc_id, item_id, q as n_item_shingles, n_shared, round(n_shared / q, 6) as containment
from m join q on q.id = item_id where n_shared * 100 >= q * 80
"""
