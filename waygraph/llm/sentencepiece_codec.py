"""SentencePiece encoding and decoding that keeps the place of every piece in the text.

The text is normalised by longest prefix through the model's compiled character map; for each
byte of the result the place it comes from is kept, so that every piece is projected back to the span of original bytes
it covers. The normalised text is cut into units that no piece of the vocabulary can span (checked
when the model is loaded); units are encoded once and remembered, up to ``CACHE_UNITS`` a worker,
and a document's pieces are its units' pieces in a row. Decoding goes from ids alone.

Defined results: a null text counts as empty, which has no ids; ill-formed input can't occur (texts
are UTF-8); very long texts are only longer lists of units; repeated rows give repeated results; an empty table gives an
empty table. ``encode_documents`` and ``decode_documents`` keep all columns but those of their own names, which they replace;
``digest_documents`` keeps the id columns that it is told, but those of its own names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer_path, drop_others, keeps, trim, with_struct

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE_UNITS = 100_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of each field of a protocol buffer message; fixed-width values stay bytes."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                size, i = _varint(b, i)
            else:
                size = 8 if kind == 1 else 4
            value = b[i : i + size]
            i += size
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie of byte strings and a pool of replacements."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.pool = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, np.uint32, size // 4, 4)
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that data has at ``at``."""
        units = self.units
        if not len(units):
            return None
        node = self._offset(int(units[0]))
        best = None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & ((1 << 31) | 0xFF) != data[k]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                start = int(units[node]) & 0x7FFFFFFF
                best = (k - at + 1, self.pool[start : self.pool.index(b"\0", start)])
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


@dataclass
class Encoding:
    ids: list[int]
    pieces: list[str]
    spans: list[tuple[int, int]]  # of bytes of the text as given


class Codec:
    """A model file, read once; see the module's text."""

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = []
        self.types: list[int] = []
        blob, flags = b"", {3: 1, 4: 1, 5: 1}
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.types.append(piece.get(3, NORMAL))
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        blob = v
                    elif n in flags:
                        flags[n] = v
        self.map = CharacterMap(blob)
        self.dummy_prefix, self.strip_spaces, self.escape = (bool(flags[n]) for n in (3, 4, 5))
        if not self.escape or any(t in (USER_DEFINED, UNUSED) for t in self.types) or any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("this model has pieces that span words, or symbols of the user's; units can't be encoded alone")
        self._names = [str(i) for i in range(len(self.pieces))]
        self._sizes = [1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types)]
        self._last_special = max((i for i, t in enumerate(self.types) if t != NORMAL), default=-1)
        if max(self._sizes) > 255:
            raise ValueError("a piece is longer than 255 bytes")
        self._drop = len(self._library.encode("\n"))
        # characters that stand in no longer piece part units, too
        joined = {c for p, t in zip(self.pieces, self.types) if len(p) > 1 and t == NORMAL for c in p}
        self._alone = "".join(c for c in "\n\r\t\x0b\x0c\x00\x1f\x7f" if c not in joined)
        self._plain = not len(self.map.units) and self.dummy_prefix and not self.strip_spaces
        self._cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._parts = re.compile(f"[{re.escape(self._alone)}]|[^{re.escape(self._alone)}]+") if self._alone else None
        self._young: dict[str, tuple[int, str, bytes, str]] = {}
        self._old: dict[str, tuple[int, str, bytes, str]] = {}

    # -- normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and for its end, where it comes from in the text's bytes."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return "", np.zeros(1, np.int64)
        out, source = bytearray(), []
        mark = SPACE.encode()

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        at = 0
        if self.strip_spaces:
            while at < len(data):
                length, piece = self._next(data, at)
                if piece != b" ":
                    break
                at += length
            if at == len(data):
                return "", np.full(1, len(data), np.int64)
        if self.dummy_prefix:
            put(mark, at)
        blank = self.strip_spaces
        while at < len(data):
            length, piece = self._next(data, at)
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                for c in piece.decode("utf-8"):
                    put(mark if c == " " else c.encode(), at)
            blank = self.strip_spaces and (piece.endswith(b" ") if piece else blank)
            at += length
        end = len(data)
        if self.strip_spaces:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = source[-len(mark)]
                del source[-len(mark) :]
        return out.decode("utf-8"), np.array([*source, end], np.int64)

    def _next(self, data: bytes, at: int) -> tuple[int, bytes]:
        if found := self.map.longest(data, at):
            return found
        c = data[at]
        length = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        return length, data[at : at + length]

    # -- encoding

    def _library_ids(self, units: list[str]) -> list[list[int]]:
        """Ids of units of normalised text; each starts with a space mark or follows a character that stands alone."""
        given = [u[1:].replace(SPACE, " ") if u.startswith(SPACE) else "\n" + u for u in units]
        found = self._library.encode(given, num_threads=1)
        return [
            ([self._library.piece_to_id(SPACE)] if u == SPACE else ids) if u.startswith(SPACE) else ids[self._drop :]
            for u, ids in zip(units, found)
        ]

    def _encode_units(self, units: list[str]) -> dict[str, tuple[int, str, bytes, str]]:
        """For each unit: number of ids, the ids as text, bytes of each piece's surface, decoded text."""
        out = {}
        names, sizes = self._names, self._sizes
        for u, ids in zip(units, self._library_ids(units)):
            raw = self.decode_raw(ids)
            out[u] = (len(ids), ",".join([names[i] for i in ids]), bytes([sizes[i] for i in ids]), u if raw == u else raw)
        return out

    def _prepare(self, units: set[str]) -> dict[str, tuple[int, str, bytes, str]]:
        """Entries of all the units. Two generations: what the young one lacks is looked up in the old one, then encoded in one call."""
        young, old = self._young, self._old
        fresh = {u: e for u in units if u not in young and (e := old.get(u)) is not None}
        if missing := [u for u in units if u not in young and u not in fresh]:
            fresh |= self._encode_units(missing)
        if len(young) + len(fresh) > CACHE_UNITS:
            fresh |= {u: young[u] for u in units if u in young}
            self._old, self._young = young, {}
        self._young.update(fresh)
        return self._young

    def _entries(self, texts: list[str]):
        """For each text, the entries of its units; texts are taken a few at a time so that new units are encoded together."""
        at = 0
        while at < len(texts):
            held, units = [], set()
            while at < len(texts) and len(units) < 50_000:
                held.append(self._units(texts[at]) if texts[at] else [])
                units.update(held[-1])
                at += 1
            get = self._prepare(units).__getitem__
            for own in held:
                yield list(map(get, own))

    def _units(self, text: str) -> list[str]:
        if self._plain:
            if not self._slow(text):
                return [u for u in (SPACE + text.replace(" ", "\0" + SPACE).replace("\n", "\0\n\0")).split("\0") if u]
            normal = SPACE + text.replace(" ", SPACE)
        else:
            normal = self.normalise(text)[0]
        return [p for u in self._cut.findall(normal) for p in (self._parts.findall(u) if self._parts else [u])]

    @staticmethod
    def _slow(text: str) -> bool:
        return "  " in text or text[0] == " " or "\0" in text or SPACE in text

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str, int]]:
        """For each text: number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text, CRC-32 of the ends of the pieces in the text's bytes."""
        out = []
        for text, entries in zip(texts, self._entries([t or "" for t in texts])):
            if not entries:
                empty = hashlib.sha256(b"").hexdigest()
                out.append((0, empty, empty, 0))
                continue
            counts, ids, sizes, raw = zip(*entries)
            decoded = self._finish("".join(raw))
            out.append(
                (
                    sum(counts),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                    zlib.crc32(self._ends(text, b"".join(sizes))),
                )
            )
        return out

    def digest(self, text: str | None) -> tuple[int, str, str, int]:
        return self.digests([text])[0]

    def _ends(self, text: str, lengths: bytes) -> np.ndarray:
        """Where each piece ends in the bytes of the text."""
        ends = np.cumsum(np.frombuffer(lengths, np.uint8), dtype=np.int64)
        if self._plain and SPACE not in text:
            # three bytes of a space mark stand for one byte, the prefix for none
            # begins of the space marks in the normalised bytes: the k-th space stands at its place in the text, moved by the prefix and 2 k bytes
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-8"), np.uint8) == 0x20)
            marks = np.concatenate([np.zeros(1, np.int64), spaces + 3 + 2 * np.arange(len(spaces))])
            return np.maximum(0, ends - 1 - 2 * np.searchsorted(marks, ends))
        return self.normalise(text)[1][ends]

    def encode(self, text: str | None) -> Encoding:
        """Ids, pieces and the spans of the text's bytes that the pieces cover."""
        if not text:
            return Encoding([], [], [])
        entries = next(self._entries([text]))
        ids = [int(i) for e in entries if e[1] for i in e[1].split(",")]
        ends = self._ends(text, b"".join(e[2] for e in entries)).tolist()
        return Encoding(ids, [self.pieces[i] for i in ids], list(zip([0, *ends[:-1]], ends)))

    # -- decoding

    def decode_raw(self, ids: list[int]) -> str:
        """The text of the pieces, with space marks as they are; runs of byte pieces become UTF-8 text."""
        if not ids or min(ids) > self._last_special:
            return "".join([self.pieces[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if kind != CONTROL:
                out.append(" ⁇ " if kind == UNKNOWN else self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def _finish(self, raw: str) -> str:
        if self.dummy_prefix and raw.startswith(SPACE):
            raw = raw[1:]
        return raw.replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        return self._finish(self.decode_raw(ids))


_LOADED: dict[str, Codec] = {}
keeps(__name__, _LOADED.clear)


def codec(path: str) -> Codec:
    """The codec of a model file, loaded once a process."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode_documents(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ids, pieces and begins and ends of the pieces in the text's bytes (arrays); no shuffle."""
    path = path or default_tokenizer_path(MODEL)

    @F.pandas_udf("ids array<int>, pieces array<string>, begins array<bigint>, ends array<bigint>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        rows = [codec(path).encode(t) for t in texts]
        return pd.DataFrame({"ids": [r.ids for r in rows], "pieces": [r.pieces for r in rows], "begins": [[a for a, _ in r.spans] for r in rows], "ends": [[b for _, b in r.spans] for r in rows]})

    return with_struct(df, encode(F.col(f"`{text_col}`")))


def decode_documents(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text that the ids decode to; null ids count as none."""
    path = path or default_tokenizer_path(MODEL)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: codec(path).decode([int(i) for i in x]) if x is not None else "")

    return with_struct(df, F.struct(decode(F.col(f"`{ids_col}`")).alias(out_col)))


def digest_documents(df: DataFrame, id_cols: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_cols`` with n_tokens, ids_sha256, decoded_sha256 and spans_crc32 of each text: the pieces themselves stay in the worker."""
    path = path or default_tokenizer_path(MODEL)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")
    def digest(texts: pd.Series) -> pd.DataFrame:
        drop_others(__name__)
        found = pd.DataFrame(codec(path).digests(list(texts)), columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])
        trim()
        return found

    found = digest(F.col(f"`{text_col}`")).alias("found")
    own = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in id_cols if c.lower() not in own]).alias("ids"), found)
    return rows.select("ids.*", "found.*")
