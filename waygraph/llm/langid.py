"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ``ORDER`` over letters (other characters count as one space) is fitted.
The n-grams of all languages stand in one sorted array of hashes, beside it one row a n-gram with the
log probability under each language, so that a lookup serves all of them. An n-gram that no language has seen
is backed off to the next lower order. The language of the lowest cross-entropy a letter wins; a text is
rejected if that is above the language's limit, calibrated on documents that the fit did not see.

Bound of the fit: at most ``max_docs`` documents a language and about ``max_chars`` characters of them, chosen by
a hash of their id over the whole table. Scoring reads every text whole.

Defined results: null texts and texts without a letter are ``und`` (score 0, rejected); very long texts
are scored piece by piece; ties go to the language first in order; rows that repeat are each answered.
Where there is nothing to learn from (an empty table, no labels, no letters) the model has no languages: every text is ``und``
with score 0, and those with letters are not rejected, as nothing speaks against them. Labelled rows without an id are not
learnt from. An empty table of texts gives an empty table. ``identify`` keeps all columns but those of its own names, which it replaces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, drop_others, lean, small_batches, trim, with_struct

ORDER = 4
DISCOUNT = 0.75
MAX_DOCS, MAX_CHARS = 400, 1_500_000
#: Of the calibration's excesses: the one that counts.
QUANTILE = 0.98
#: Times MAX_DOCS: rows of a language that are expected to be ranked.
SPARE = 4
#: Letters that the models tell apart; all others share one code.
LETTERS = 4000
_OTHER, _EDGE = 1, 0
_PIECE = 1 << 19
_BITS = 12  # a code is below 2**12, so that five of them fit a key


def _lower_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x323AF or 0x17000 <= cp <= 0x18CFF:
            continue
        if unicodedata.category(c := chr(cp))[0] == "L":
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    for a, b in ((0xAC00, 0xD7A3), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBE0), (0x30000, 0x323AF), (0x17000, 0x187F7), (0x18800, 0x18CD5)):
        table[a : b + 1] = np.arange(a, b + 1)
    return table


_TABLES: dict[str, np.ndarray] = {}


def letters_of(text: str) -> np.ndarray:
    """The lower-cased letters as code points; each run of other characters is one 0, and so are both ends."""
    if "lower" not in _TABLES:
        _TABLES["lower"] = _lower_table()
    cps = _TABLES["lower"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    cps = np.concatenate([np.zeros(1, np.uint32), cps, np.zeros(1, np.uint32)])
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 0) | (cps[:-1] != 0)
    return cps[keep]


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A key for each n-gram that ends at position n - 1 or later; the order is part of the key."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    key = np.full(m, n, np.int64)
    for j in range(n):
        key = (key << _BITS) | codes[j : m + j]
    return key


def _scramble(keys: np.ndarray) -> np.ndarray:
    k = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return k ^ (k >> np.uint64(29))


@dataclass
class Model:
    """langs in order; letters: the code points with codes of their own, sorted."""

    langs: list[str]
    letters: np.ndarray
    hashes: np.ndarray  # sorted
    logp: np.ndarray  # a row a hash, a column a language; natural logarithms
    backoff: np.ndarray  # of the n-gram as a context
    starts: np.ndarray  # for each value of the top bits, where its hashes begin
    top: int
    limits: np.ndarray  # for each language: mean, spread and floor of the calibration

    def codes(self, cps: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, cps), len(self.letters) - 1)
        return np.where(cps == 0, _EDGE, np.where(self.letters[at] == cps, at + 2, _OTHER)).astype(np.int64)

    def _code_table(self) -> np.ndarray:
        if not hasattr(self, "_codes"):
            if "lower" not in _TABLES:
                _TABLES["lower"] = _lower_table()
            self._codes = self.codes(_TABLES["lower"]).astype(np.int16)
        return self._codes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1: the top bits of its hash give the stretch of the sorted array to look at."""
        h = _scramble(keys)
        bucket = (h >> np.uint64(64 - self.top)).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        row = np.where(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h, at, -1)
        open_ = np.flatnonzero((row < 0) & (at + 1 < stop))
        while len(open_):
            at[open_] += 1
            hit = self.hashes[at[open_]] == h[open_]
            row[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            open_ = open_[at[open_] + 1 < stop[open_]]
        return row

    @classmethod
    def without_languages(cls) -> Model:
        none = np.zeros(0)
        return cls([], np.zeros(1, np.uint32), none.astype(np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(2, np.int64), 0, np.zeros((0, 3)))

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: summed -log p under each language, and the number of letters and gaps scored (0 without a letter)."""
        total, scored = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        owners: list[int] = []
        pieces: list[str] = []
        held = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), _PIECE):
                owners.append(k)
                pieces.append(text[at : at + _PIECE])
                held += len(pieces[-1])
                if held >= _PIECE:
                    self._score(pieces, owners, total, scored)
                    owners, pieces, held = [], [], 0
        if pieces:
            self._score(pieces, owners, total, scored)
        return total, scored

    def _score(self, pieces: list[str], owners: list[int], total: np.ndarray, scored: np.ndarray) -> None:
        raw = self._code_table()[np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum([1, *[len(x) + 1 for x in pieces]])  # in raw; a piece ends with its separator
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
        at = np.cumsum(keep)[begins - 1]  # where each piece begins among the kept codes
        lengths = np.diff(at)
        codes = raw[keep].astype(np.int64)
        gaps = np.repeat(at[:-1], ORDER - 2)
        codes = np.insert(codes, gaps, 0)  # no context reaches into the piece before
        starts = at[:-1] + (ORDER - 2) * np.arange(1, len(pieces) + 1)
        which = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[which]
        loss = np.zeros((len(which), len(self.langs)), np.float32)
        rest = np.arange(len(which))
        for n in range(ORDER, 0, -1):
            row = self.find(self._at(codes, ends[rest], n))
            hit = row >= 0
            loss[rest[hit]] -= self.logp[row[hit]]
            rest = rest[~hit]
            if n > 1 and len(rest):
                context = self.find(self._at(codes, ends[rest] - 1, n - 1))
                known = context >= 0
                loss[rest[known]] -= self.backoff[context[known]]
        some = np.flatnonzero(lengths)
        if not len(some):
            return
        sums = np.add.reduceat(loss, (np.cumsum(lengths) - lengths)[some], axis=0, dtype=np.float64)
        has_letter = np.add.reduceat((codes[ends] != 0).astype(np.int64), (np.cumsum(lengths) - lengths)[some])
        for k, s, n, letters in zip(some, sums, lengths[some], has_letter):
            if letters:
                total[owners[k]] += s
                scored[owners[k]] += n

    @staticmethod
    def _at(codes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        key = np.full(len(ends), n, np.int64)
        for j in range(n - 1, -1, -1):
            key = (key << _BITS) | codes[ends - j]
        return key


def fit(counts: pd.DataFrame, langs: list[str]) -> Model:
    """A model from counts of n-grams of order ``ORDER`` (columns lang, gram; gram holds code points) with padding at the start."""
    cps = np.array(counts["gram"].tolist(), np.uint32).reshape(-1, ORDER)
    weight = counts["n"].to_numpy(np.float64)
    lang = counts["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()
    seen, sums = np.unique(cps[:, -1], return_inverse=True)
    freq = np.bincount(sums, weight)
    letters = np.sort(seen[(seen > 0)][np.argsort(-freq[seen > 0], kind="stable")[:LETTERS]])
    model = Model(langs, letters if len(letters) else np.zeros(1, np.uint32), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), 0, np.zeros((len(langs), 3)))
    codes = model.codes(cps)
    size = len(letters) + 2
    per: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    for k in range(len(langs)):
        own, w = codes[lang == k], weight[lang == k]
        tables = {}
        keys = _matrix_keys(own)
        u, inv = np.unique(keys, return_inverse=True)
        tables[ORDER] = (u, np.bincount(inv, w, len(u)))
        grams = _unkey(u, ORDER)
        for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many contexts to the left
            keys = _matrix_keys(grams[:, 1:])
            u, inv = np.unique(keys, return_inverse=True)
            tables[n] = (u, np.bincount(inv, minlength=len(u)).astype(np.float64))
            grams = _unkey(u, n)
        per.append(tables)
    # all n-grams of any language, order by order; a lower order's probabilities serve the next
    all_keys, all_logp, all_back = [], [], []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    backs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([t[n][0] for t in per]))
        grams = _unkey(union, n)
        p = np.zeros((len(union), len(langs)))
        contexts = np.unique(np.concatenate([_matrix_keys(_unkey(t[n][0], n)[:, :-1]) for t in per])) if n > 1 else np.zeros(1, np.int64)
        back = np.ones((len(contexts), len(langs)))
        base = np.full((len(union), len(langs)), 1.0 / size) if n == 1 else lower[1][np.searchsorted(lower[0], _matrix_keys(grams[:, 1:]))]
        ctx_of = np.searchsorted(contexts, _matrix_keys(grams[:, :-1])) if n > 1 else np.zeros(len(union), np.int64)
        for k, t in enumerate(per):
            keys, c = t[n]
            at = np.searchsorted(union, keys)
            of = ctx_of[at]
            total = np.bincount(of, c, len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            with np.errstate(invalid="ignore", divide="ignore"):
                back[:, k] = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
                full = np.zeros(len(union))
                full[at] = np.maximum(c - DISCOUNT, 0) / total[of]
            p[:, k] = full + back[ctx_of, k] * base[:, k]
        if n > 1:
            backs[n - 1] = (contexts, np.log(back))
        else:
            unseen = back[0] / size
        lower = (union, p)
        all_keys.append(union)
        all_logp.append(np.log(p))
    for n in range(1, ORDER + 1):
        b = np.zeros((len(all_keys[n - 1]), len(langs)))
        if n in backs:
            contexts, values = backs[n]
            at = np.searchsorted(all_keys[n - 1], contexts)
            ok = (at < len(all_keys[n - 1])) & (all_keys[n - 1][np.minimum(at, len(all_keys[n - 1]) - 1)] == contexts)
            # contexts that never end an n-gram (those at the start of a text) get a row of their own
            b[at[ok]] = values[ok]
            extra = np.flatnonzero(~ok)
            if len(extra):
                all_keys.append(contexts[extra])
                all_logp.append(_chain(contexts[extra], n, all_keys, all_logp, all_back, unseen))
                all_back.append((len(all_keys) - 1, values[extra]))
        all_back.insert(n - 1, (n - 1, b))
    order = {k: v for k, v in all_back}
    # each code has an order-one row, so that every search ends
    ones = _matrix_keys(np.arange(size).reshape(-1, 1))
    missing = np.setdiff1d(ones, np.concatenate(all_keys))
    keys = np.concatenate([*all_keys, missing])
    logp = np.concatenate([*all_logp, np.tile(np.log(unseen), (len(missing), 1))])
    back = np.concatenate([*[order[k] for k in range(len(all_keys))], np.zeros((len(missing), len(langs)))])
    h = _scramble(keys)
    s = np.argsort(h)
    model.hashes, model.logp, model.backoff = h[s], logp[s].astype(np.float32), back[s].astype(np.float32)
    model.top = max(4, int(len(h)).bit_length() + 1)
    model.starts = np.searchsorted(model.hashes, np.arange(1 << model.top, dtype=np.uint64) << np.uint64(64 - model.top))
    model.starts = np.append(model.starts, len(h)).astype(np.int64)
    return model


def _chain(keys, n, all_keys, all_logp, all_back, unseen):
    """Log probabilities of n-grams that were only ever seen as contexts: those of their last letter alone."""
    last = _unkey(keys, n)[:, -1:]
    at = np.searchsorted(all_keys[0], _matrix_keys(last))
    at = np.minimum(at, len(all_keys[0]) - 1)
    found = all_keys[0][at] == _matrix_keys(last)
    return np.where(found[:, None], all_logp[0][at], np.log(unseen))


def _matrix_keys(codes: np.ndarray) -> np.ndarray:
    key = np.full(len(codes), codes.shape[1], np.int64)
    for j in range(codes.shape[1]):
        key = (key << _BITS) | codes[:, j]
    return key


def _unkey(keys: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(keys >> (_BITS * (n - 1 - j))) & ((1 << _BITS) - 1) for j in range(n)], axis=1) if n else np.zeros((len(keys), 0), np.int64)


def ngram_counts(texts: Iterator[tuple[str, str]]) -> pd.DataFrame:
    """lang, gram, n over the (lang, text) pairs; each text starts with ORDER - 1 edges."""
    parts: dict[str, list[np.ndarray]] = {}
    for lang, text in texts:
        cps = letters_of(text or "")
        if not cps.any():
            continue
        parts.setdefault(lang, []).append(np.concatenate([np.zeros(ORDER - 2, np.uint32), cps]))
    frames = []
    for lang, arrays in parts.items():
        whole = np.concatenate(arrays)
        own, ids = np.unique(whole, return_inverse=True)
        ids, starts = ids.astype(np.int64), np.cumsum([0, *map(len, arrays)])
        key = np.zeros(len(ids) - ORDER + 1, np.int64)
        for j in range(ORDER):
            key = key * len(own) + ids[j : len(key) + j]
        inside = np.ones(len(key), bool)
        for at in starts[1:-1]:
            inside[max(0, at - ORDER + 1) : at] = False
        u, n = np.unique(key[inside], return_counts=True)
        grams = np.stack([own[(u // len(own) ** (ORDER - 1 - j)) % len(own)] for j in range(ORDER)], axis=1)
        frames.append(pd.DataFrame({"lang": lang, "gram": list(grams.astype(np.int32)), "n": n}))
    if frames:
        return pd.concat(frames, ignore_index=True)
    return pd.DataFrame({"lang": pd.Series([], dtype=object), "gram": pd.Series([], dtype=object), "n": pd.Series([], dtype=np.int64)})


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Fits and calibrates a model on the rows of ``labelled`` that have a text and a language.

    The choice takes the ``max_docs`` rows of each language with the least hash of their id, then, in that order,
    rows until ``max_chars`` is reached. Rows are counted first, so that only hashes below a bound that
    ``SPARE`` times as many rows pass are ranked; should too few pass it (rows that repeat share a hash), all are ranked.
    Every fifth chosen row is kept from the counts for the calibration.
    """
    q = lambda c: F.col(f"`{c}`")
    rows = labelled.where(q(text_col).isNotNull() & q(lang_col).isNotNull())
    slim = rows.select(q(id_col).alias("id"), q(lang_col).alias("lang"), F.length(q(text_col)).alias("len"), F.xxhash64(F.lit(11), q(id_col), F.length(q(text_col))).alias("h"))
    counts = cut(slim.groupBy("lang").agg(F.count("*").alias("n")))
    by = Window.partitionBy("lang").orderBy("h", "id")
    for spare in (SPARE, None):
        ranked = slim
        if spare:
            below = F.shiftrightunsigned("h", 1) < F.lit(float(1 << 63)) * spare * max_docs / F.col("n")
            ranked = slim.join(bounded(counts), "lang").where(below).drop("n")
        ranked = ranked.withColumn("r", F.row_number().over(by)).where(F.col("r") <= max_docs)
        ranked = cut(ranked.withColumn("upto", F.sum("len").over(by.rowsBetween(Window.unboundedPreceding, -1))))
        if ranked.count() == counts.agg(F.sum(F.least("n", F.lit(max_docs)))).first()[0]:
            break
    chosen = cut(ranked.where(F.coalesce("upto", F.lit(0)) < max_chars).select("id", F.col("lang").alias("_lang"), (F.col("r") % 5 == 0).alias("held")))
    # at most max_docs rows a language; languages are counted before they are broadcast
    sample = rows.select(q(id_col).alias("id"), q(text_col).alias("text"), q(lang_col).alias("lang")).join(bounded(cut(chosen.dropDuplicates(["id"]))), "id").where("lang = _lang")

    def count(frames):
        for frame in frames:
            frame = frame[~frame["held"]]
            if len(found := ngram_counts(zip(frame["lang"], frame["text"]))):
                yield found

    grams = sample.select("lang", "text", "held").mapInPandas(lean(count), "lang string, gram array<int>, n bigint")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return Model.without_languages()
    langs = sorted(counts["lang"].unique())
    model = fit(counts.sort_values(["lang", "n"], kind="stable"), langs)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def held_out(frames):
        for frame in frames:
            frame = frame[frame["held"] & frame["lang"].isin(langs)]
            losses, ns = shared.value.losses(list(frame["text"]))
            out = [(lang, int(n), float(loss[langs.index(lang)]) / n) for lang, loss, n in zip(frame["lang"], losses, ns) if n]
            if out:
                yield pd.DataFrame(out, columns=["lang", "n", "h"])

    held = sample.select("lang", "text", "held").mapInPandas(lean(held_out), "lang string, n bigint, h double").toPandas()
    for k, lang in enumerate(langs):
        own = held[(held["lang"] == lang)]
        long = own[own["n"] >= 100]
        use = long if len(long) >= 5 else own
        if len(use):
            mean = float(use["h"].mean())
            spread = float(use["h"].std()) if len(use) > 1 else 0.0
            # short texts vary more: a high quantile of the excess, on the scale of a single letter (the widest one may be junk)
            widest = float(((own["h"] - mean).clip(lower=0) * np.sqrt(own["n"])).quantile(QUANTILE))
            model.limits[k] = (mean, spread, widest)
        else:
            model.limits[k] = (np.log(len(model.letters) + 2), 1.0, 1.0)
    return model


#: Rejected is what lies further out than SLACK times the calibration's excess, SPREADS times its spread and MARGIN nats a letter.
SLACK, SPREADS, MARGIN = 1.5, 6, 1.25


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
    """For each text: language, score from 0 to 1, cross-entropy in nats a letter, and whether it is rejected."""
    out = []
    if not model.langs:
        return [("und", 0.0, None, not letters_of(t or "").any()) for t in texts]
    for loss, n in zip(*model.losses([t or "" for t in texts])):
        if not n:
            out.append(("und", 0.0, None, True))
            continue
        h = loss / n
        k = int(np.argmin(h))
        score = 1.0 / float(np.exp(-(h - h[k]) * min(n, 40)).sum())
        mean, spread, widest = model.limits[k]
        limit = mean + max(MARGIN, SPREADS * spread, SLACK * widest / np.sqrt(n))
        out.append((model.langs[k], round(score, 6), float(h[k]), bool(h[k] > limit)))
    return out


def predict_text(model: Model, text: str | None) -> tuple[str, float, float | None, bool]:
    return predict_texts(model, [text])[0]


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy and rejected in place of columns of these names; no shuffle. The model is a few MB, bounded by the fit's bound."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        drop_others()
        found = pd.DataFrame(predict_texts(shared.value, list(texts)), columns=["lang_pred", "score", "cross_entropy", "rejected"])
        trim()
        return found

    return with_struct(df, predict(F.col(f"`{text_col}`")))


def without_rejected(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``identify`` rejects; all columns kept, whatever their names."""
    small_batches(df.sparkSession)
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kept = identify(row, model).where("not rejected")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
