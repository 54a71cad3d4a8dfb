"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Offline, for each string of the vocabulary, it is proved whether it is encoded as one token when it stands alone: the
pre-tokeniser must leave it whole and the merges must end in a single symbol. Texts are then cut
into pre-tokens; those in the proved set count one each without a merge, only the rest are merged
(and remembered, up to ``CACHE`` a worker).

Defined results: a null text counts as empty, with no token; the strings of special tokens inside a
text count one each, as the library's default has it; repeated rows give repeated results; a very long text is one row, its
pre-tokens counted by kind; an empty table gives an empty table. ``count_tokens`` keeps all columns but those of its own names, which it replaces.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer_path, with_struct

VOCABULARY = "byte_bpe_50k.json"
CACHE = 200_000
#: How byte-level vocabularies cut texts before the merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counts:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE vocabulary of the kind this operator counts")
        self._find = regex.compile(PATTERN).findall
        specials = [t for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials):
            raise ValueError("special tokens that take in what is beside them are not handled")
        self.specials = sorted((t["content"] for t in specials), key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if specials else None
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # rank of a merge result: single bytes first, then in the order of the merges
        ranks = {bytes([b]): b for b in range(256)}
        for k, (a, b) in enumerate(merges):
            ranks.setdefault(raw[a] + raw[b], 256 + k)
        self.pairs = {(raw[a], raw[b]): k for k, (a, b) in enumerate(merges)}
        self._merge = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = self.proved(raw.values())
        self._young: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The symbols that the merge list leaves of the bytes: the plain rule, used for the proof."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.pairs.get(p, 1 << 60))
            if best not in self.pairs:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def proved(self, strings) -> frozenset[str]:
        """The strings that stand alone as one pre-token and one token."""
        found = set()
        for data in strings:
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self._find(text) == [text] and len(self.merged(data)) == 1:
                found.add(text)
        return frozenset(found)

    def _plain(self, text: str) -> int:
        counted = Counter(self._find(text))
        whole, young, old = self.whole, self._young, self._old
        total = 0
        for piece, times in counted.items():
            if piece in whole:
                total += times
                continue
            n = young.get(piece)
            if n is None:
                n = old.get(piece)
                if n is None:
                    n = len(self._merge._encode_single_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(young) >= CACHE:
                        self._old, self._young = young, {}
                        young, old = self._young, self._old
                    young[piece] = n
            total += n * times
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._split and any(s in text for s in self.specials):
            return sum(1 if k % 2 else self._plain(part) for k, part in enumerate(self._split(text)) if part)
        return self._plain(text)


_LOADED: dict[str, Counts] = {}


def counts(path: str) -> Counts:
    if path not in _LOADED:
        _LOADED[path] = Counts(path)
    return _LOADED[path]


def count_tokens(df: DataFrame, text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > limit) of each text, in place of columns of these names; no shuffle."""
    path = path or default_tokenizer_path(VOCABULARY)

    @F.pandas_udf("bigint")
    def tokens(texts: pd.Series) -> pd.Series:
        c = counts(path)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    text = F.col(f"`{text_col}`")
    n = tokens(text)
    return with_struct(df, F.struct(F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit")))
