"""The pipeline and the registered queries, run as the driver runs them, on small tables."""

import hashlib
import random
import zlib

import pytest

import __spark_entry__
from waygraph.llm import substring_dedup
from waygraph.llm.common import default_tokenizer_path
from waygraph.llm.sentencepiece_codec import MODEL

from test_corpus_operators import SCHEMA, components_of, contained

sentencepiece = pytest.importorskip("sentencepiece")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

STEMS = {
    "en": "the of and to in that was with this have from they which would their about there other".split(),
    "de": "der die und das nicht ein ist von zu mit sich auf werden wurde durch einer haben schon".split(),
}
BENCH = "item_id bigint, text string"


def prose(rng, lang, n):
    """Words of a language, each fifth with a second one joined on, so that passages don't repeat by chance."""
    return " ".join(rng.choice(STEMS[lang]) + (rng.choice(STEMS[lang]) + rng.choice(STEMS[lang]) if k % 2 else "") for k in range(n))


def corpus(rng):
    texts = [(prose(rng, lang, rng.randrange(40, 120)), lang) for lang in ("en", "de") for _ in range(25)]
    base = [t for t, _ in texts]
    near = base[3].split()
    near[5] = "changed"
    passage = prose(rng, "en", 45)
    items = [prose(rng, "en", 15), prose(rng, "de", 30), "short", None]
    texts += [(base[0], "en"), (base[0], "en"), (" ".join(near), "en"), (base[30] + " und", "de")]
    texts += [(f"{prose(rng, 'en', 30)} {passage} {prose(rng, 'en', 30)} \u00e9\ufffd", "en") for _ in range(4)]
    texts += [(f"{prose(rng, 'en', 40)} {items[0]} {prose(rng, 'en', 9)}", "en"), (f"{items[1].upper()}, {prose(rng, 'de', 80)}", None)]
    texts += [(None, "en"), ("", None), ("12 34 !!", "en"), (None, None)]
    return texts, items


def write(spark, folder, texts, items, extra=()):
    rows = spark.createDataFrame([(k, t, lang, f"s{k % 3}", None if t is None else len(t)) for k, (t, lang) in enumerate(texts)], SCHEMA)
    for name in extra:
        rows = rows.selectExpr("*", f"'own' as `{name}`")
    rows.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), BENCH).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_brute_force(texts, items):
    left = [(k, t) for k, (t, _) in enumerate(texts) if t and any(c.isalpha() for c in t)]
    label, sizes = components_of([t for _, t in left], 5, 80)
    left = [x for k, x in enumerate(left) if label[k] == k or not sizes[k]]
    data = [t.encode() for _, t in left]
    seen, n = {}, substring_dedup.LENGTH
    for b in data:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    cut = []
    for (k, _), b in zip(left, data):
        spans = substring_dedup.merge_spans([(i, i + n) for i in range(len(b) - n + 1) if seen[b[i : i + n]] > 1])
        cut.append((k, "".join(x.decode("utf-8", "ignore") for x in substring_dedup.kept_parts(b, spans))))
    hit = {k for k, _ in contained([t for _, t in cut], items)}
    return [x for k, x in enumerate(cut) if k not in hit], len(left), sum(a != texts[k][0] for k, a in cut), len(hit)


@pytest.mark.parametrize("extra", [(), ("sha", "rk", "lang_pred", "rejected", "label", "kept", "n_tokens", "row", "part", "n")])
def test_pipeline_by_brute_force(spark, tmp_path, extra):
    texts, items = corpus(random.Random(17))
    want, *effects = by_brute_force(texts, items)
    assert effects == [56, 4, 2]
    folder = write(spark, tmp_path, texts, items, extra)
    library = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer_path(MODEL))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = {k: (len(library.encode(t)), digest(",".join(map(str, library.encode(t)))), digest(library.decode(library.encode(t)))) for k, t in want}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in __spark_entry__.queries()["pipeline"](spark, folder).collect()}
    assert got == expected
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        assert all(v == "own" for r in docs.select(*extra).collect() for v in r)


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "a", [], [])).count() == 0
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "b", [(None, None), (None, "en"), ("", "en")], [None, ""])).count() == 0


def test_queries_of_small_tables(spark, tmp_path):
    """Each query once over rows with nulls, repeats and texts of all lengths, and once over empty tables."""
    texts, items = corpus(random.Random(3))
    full, empty = write(spark, tmp_path / "full", texts, items), write(spark, tmp_path / "empty", [], [])
    pages = [(1, "u", "<article><p>The text of it.</p></article>"), (2, None, None), (None, "u", "")]
    talk = [(1, 0, "user", "Hello there."), (1, 1, "user", "> Hello there.\nYes."), (None, None, None, None)]
    for folder, keep in ((full, True), (empty, False)):
        spark.createDataFrame(pages if keep else [], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
        spark.createDataFrame(talk if keep else [], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    queries = {name: q for name, q in __spark_entry__.queries().items() if name[:2] == "op" and name[2].isdigit()}
    assert sorted(int(n[2:].split("_")[0]) for n in queries) == list(range(1, 11))
    for name, query in queries.items():
        got = query(spark, full).collect()
        assert len(got) == {"op1_html_extraction": 3, "op4_chat_formatting": 3, "op8_decontamination": len(got)}.get(name, len(texts)), name
        assert query(spark, empty).collect() == [], name
    part = {k: zlib.crc32(str(k).encode()) % 4 for k in range(len(texts))}
    langs = queries["op5_language_id"](spark, full).collect()
    assert {r.doc_id: r.held_out for r in langs} == {k: v == 2 for k, v in part.items()}
    assert sum(r.lang_pred == texts[r.doc_id][1] for r in langs if r.held_out and r.lang_pred != "und") >= 0.9 * sum(r.held_out and r.lang_pred != "und" for r in langs) - 1
    found = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in queries["op8_decontamination"](spark, full).collect()}
    assert found == contained([t for t, _ in texts], items) and len(found) == 2
