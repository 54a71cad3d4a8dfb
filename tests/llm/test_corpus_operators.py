"""Operators over the whole corpus, against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waygraph.llm import common, components, decontaminate, ngram_join, sentencepiece_codec, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components_of(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return [root(x) for x in range(len(texts))], [len(s) for s in sets]


def family(rng, n, size, changes):
    base = words(rng, size, 5000)
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,percent,block", [(3, 90, 400), (3, 90, 6), (5, 80, 6)])
def test_jaccard_components(spark, k, percent, block):
    rng = random.Random(k * block)
    texts = [None, "", "one", "One", "one two", "\t\n", " ".join(words(rng, 60)), *family(rng, 40, 80, 6), *family(rng, 12, 30, 2), *family(rng, 6, 300, 40)]
    passage = " ".join(words(rng, 50, 10**6))
    texts += [" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 40)) for _ in range(25)]
    texts += [texts[8]] * 9 + ["a b c d e f g h i j"] * 3
    rng.shuffle(texts)
    got = ngram_join.jaccard_classes(docs(spark, texts), k, percent, block=block).collect()
    want, sizes = components_of(texts, k, percent)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {d: (want[d], sizes[d]) for d in range(len(texts))}
    kept = ngram_join.keep_one_each(docs(spark, texts), k, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({want[d] if sizes[d] else d for d in range(len(texts))})


def test_jaccard_join_of_little(spark):
    empty = docs(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert ngram_join.jaccard_classes(empty).count() == 0 and ngram_join.keep_one_each(empty).count() == 0
    twice = docs(spark, ["a b c"]).union(docs(spark, ["a b c"])).union(spark.createDataFrame([(None, "a b c", None, None, 5)], SCHEMA))
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(twice).collect()} == {(0, 0), (None, 0)}
    assert ngram_join.keep_one_each(docs(spark, ["a b c"]).union(docs(spark, ["a b c"]))).count() == 1


def removed(texts, n):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        m = substring_dedup.merge_spans([(i, i + n) for i in range(len(b) - n + 1) if count[b[i : i + n]] > 1])
        kept = substring_dedup.remove_spans(b, m)
        out.append((len(b), len(b) - len(kept), len(m), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot,block_bytes,hot_owners", [(4000, 1 << 20, 1000), (1, 500, 1000), (3, 2000, 8), (4000, 1 << 20, 0)])
def test_repeats_by_brute_force(spark, hot, block_bytes, hot_owners):
    rng = random.Random(hot)
    part = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [part(rng.randrange(30, 120)) for _ in range(6)]
    texts = [None, "", part(39), "ab" * 300, "abc" * 20 + part(50) + "abc" * 20]
    texts += ["".join(rng.choice([part(rng.randrange(60)), rng.choice(passages)]) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    texts += [texts[20]] * 3 + [texts[21] + "z"]
    got = substring_dedup.remove_repeats(docs(spark, texts), length=40, stretch=17, hot=hot, block_bytes=block_bytes, hot_owners=hot_owners).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(removed(texts, 40)))


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"hot_bytes": 60}, {"block_bytes": 1}, {"hot_owners": 2}])
def test_any_byte_may_occur(spark, options):
    """NUL bytes: a text that holds the end of one text, a NUL and the start of another repeats neither."""
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("ab\0\x01\ufffd") for _ in range(n))
    core = part(60)
    texts = [part(30) + core, core + part(30), part(45) + core + part(45)]
    texts += [texts[0][-25:] + "\0" + texts[1][:25], "\0" * 90, "\0" * 39, core[:20] + "\0" + core[:20], core[-39:] + "\0", "\0" + core[:39]]
    texts += [part(rng.randrange(80)) + rng.choice([core, core[:45], core[20:]]) + part(rng.randrange(50)) for _ in range(30)]
    got = substring_dedup.remove_repeats(docs(spark, texts), length=40, stretch=17, **options).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(removed(texts, 40)))
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs(spark, texts), length=40, stretch=17, **options).collect()}
    for k, text in enumerate(texts):
        b = text.encode()
        spans = substring_dedup.merge_spans([(i, i + 40) for i in range(len(b) - 39) if sum(t.encode().count(b[i : i + 40]) for t in texts) > 1 or b.count(b[i : i + 40]) > 1 or b.find(b[i : i + 40], b.find(b[i : i + 40]) + 1) >= 0])
        assert cut[k] == "".join(x.decode("utf-8", "ignore") for x in substring_dedup.kept_parts(b, spans))


def test_halves_of_two_characters_make_no_third():
    data = "\u00e9xx\u00e8".encode()
    assert [x.decode("utf-8", "ignore") for x in substring_dedup.kept_parts(data, [(1, 5)])] == ["", ""]
    block = [b"B" * 30 + b"\0" * 2, b"C" * 40, b"B" * 20 + b"\0" + b"C" * 20]
    assert not any(f.any() for f in substring_dedup.repeats_in_block([block[0][:32], b"C" * 20 + b"D" * 20, block[2]], [1, 1, 1], 40))


def test_without_repeats_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "x" * 300, 7, "a"), (2, "y", None, "b"), (2, "y", None, "b")], "doc_id bigint, text string, n_chars int, sha string")
    rows = rows.withColumnsRenamed({}).selectExpr("*", "sha as kept", "n_chars as rid", "1 as whole", "2 as uid")
    got = substring_dedup.without_repeats(rows)
    assert got.schema["n_chars"].dataType == rows.schema["n_chars"].dataType and got.columns == rows.columns
    assert sorted((r.doc_id, r.text, r.sha, r.kept, r.whole, r.uid) for r in got.collect()) == [(1, "", "a", "a", 1, 2), (2, "y", "b", "b", 1, 2), (2, "y", "b", "b", 1, 2)]
    assert substring_dedup.remove_repeats(rows).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeats_across_pieces(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 64)
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(700))
    keys, first, last, _ = substring_dedup.runs_of(data, 40, 17)
    assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == 660
    at = {data[s : s + 40]: set() for s in range(661)}
    for k, a, b in zip(keys, first, last):
        for s in range(a, b + 1):
            at[data[s : s + 40]].add(k)
    assert all(len(v) == 1 for v in at.values())


def test_texts_without_repeats(spark):
    rng = random.Random(9)
    part = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = part(230)
    rows = docs(spark, [part(50) + common + part(60), part(80) + common, part(300), None]).union(spark.createDataFrame([(None, "x", None, None, 1)], SCHEMA))
    got = {r.doc_id: r for r in substring_dedup.without_repeats(rows).collect()}
    assert len(got) == 5 and (got[0].n_chars, got[1].n_chars, got[2].n_chars) == (110, 80, 300) and got[3].text is None
    assert substring_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def contained(texts, items, percent=80):
    def sh(t):
        w = [x for x in re.split(r"[^a-z0-9]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    d = [sh(t) for t in texts]
    return {(k, j): (len(sh(i)), len(sh(i) & s)) for k, s in enumerate(d) for j, i in enumerate(items) if sh(i) and 100 * len(sh(i) & s) >= percent * len(sh(i))}


def test_items_in_documents(spark):
    rng = random.Random(6)
    items = [" ".join(words(rng, n)) for n in (5, 6, 9, 15, 40, 59, 200)] + ["four words are few", "", None]
    texts = []
    for _ in range(60):
        own = words(rng, rng.randrange(300))
        for _ in range(rng.randrange(3)):
            item = (items[rng.randrange(7)] or "").split()
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = "changed"
            own += item
        texts.append(" ".join(own).upper() if rng.random() < 0.3 else " , ".join(own))
    texts += [None, "", items[4], "!! " + items[5] + " ?", "Four words, are few!", "four words are few indeed"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontaminate.find_contained(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in got} == contained(texts, items) and got
    clean = {r.doc_id for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert clean == set(range(len(texts))) - {r.doc_id for r in got}
    twice = decontaminate.find_contained(docs(spark, texts).union(docs(spark, texts)), bench.union(bench))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, got))
    assert decontaminate.find_contained(docs(spark, texts), bench.limit(0)).count() == 0


def test_an_item_over_rows_of_one_document(spark):
    """Ten shingles, eight needed; two rows of one id hold six each, together ten."""
    item = [f"w{k}" for k in range(14)]
    rows = docs(spark, [" ".join(item[:10]), " ".join(item[:10]), " ".join(item)]).union(docs(spark, [" ".join(item[4:])]))
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.find_contained(rows, bench).collect()}
    assert got == {(0, 7, 10), (2, 7, 10)}


def test_shingles_of_documents_are_made_once(spark):
    """Inferred filters must not inline the shingle chain."""
    sketch = spark.createDataFrame([(7, 3, 5)], "item_id bigint, least int, h bigint")
    limits = [0] * decontaminate.PARTITIONS
    probes = decontaminate._probes(docs(spark, ["a b c d e f g h"]), "doc_id", "text", limits)
    found = probes.join(F.broadcast(sketch), "h").where("coalesce(part, -1) >= least")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1, plan


def test_decontaminated_rows_keep_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 5, "p"), (None, "a b c d e f", 6, "q"), (2, "z", 7, "r")], "doc_id bigint, text string, n int, item_id string").selectExpr("*", "n as part", "n as least", "n as id")
    bench = spark.createDataFrame([(7, "a b c d e", "x")], "item_id bigint, text string, doc_id string")
    kept = decontaminate.decontaminate(rows, bench)
    assert kept.columns == rows.columns and {(r.doc_id, r.n, r.item_id, r.id) for r in kept.collect()} == {(None, 6, "q", 6), (2, 7, "r", 7)}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_components_both_ways(spark, limit):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = components.connected_components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint"), limit)
    assert dict(map(tuple, got.collect())) == label


def test_texts_go_to_python_in_small_batches(spark):
    """A batch of texts is held several times on both sides; a lower limit of the session's stays."""
    from waygraph.llm import common, ngram_join, substring_dedup

    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    before = spark.conf.get(name)
    try:
        for operator in (ngram_join.jaccard_classes, substring_dedup.remove_repeats):
            for given, want in ((10_000, common.BATCH_ROWS), (0, common.BATCH_ROWS), (7, 7)):
                spark.conf.set(name, given)
                operator(docs)
                assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)


def test_a_block_takes_few_bytes_a_symbol():
    rng = np.random.default_rng(5)
    contexts = [bytes(rng.integers(97, 101, 700, dtype=np.uint8)) for _ in range(300)]
    contexts += [c[100:450] for c in contexts[::5]]
    tracemalloc.start()
    found = substring_dedup.repeats_in_block(contexts, [1] * len(contexts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int(f.sum()) for f in found[:6]] == [151, 0, 0, 0, 0, 151] and all(f.all() for f in found[300:])
    assert peak < 60 * sum(len(c) + 1 for c in contexts)


def test_a_worker_lets_go_of_what_other_operators_kept():
    path = common.default_tokenizer_path(sentencepiece_codec.MODEL)
    kept = sentencepiece_codec.codec(path)
    common.drop_others(sentencepiece_codec.__name__)
    assert sentencepiece_codec.codec(path) is kept
    frames = [pd.DataFrame({"a": [k]}) for k in range(3)]
    assert [f["a"][0] for f in common.lean(lambda given: given)(iter(frames))] == [0, 1, 2]
    assert sentencepiece_codec.codec(path) is not kept
