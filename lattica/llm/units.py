"""Tokenizing by distinct units: texts are cut where a tokenizer's own splitting can never join, each distinct
unit of a slice is encoded once by the tokenizers library, and the ids are gathered back by position.

A cut stands before a space or line feed whose next byte is plainly not white space. In front of such a byte
neither the byte-level pattern (which joins at most one space to the word that follows) nor the word pattern
(which drops white space) makes one piece of both sides, and normalisation does not reach over it. "<" is no such
byte, since it may begin a special token, before which spaces belong together.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .arrow import flat, strings

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0xC3:0xCC] = True  # lead bytes of U+00C0 to U+02FF: no white space, no combining marks
_PLAIN[ord("<")] = False

#: Distinct units, and distinct pieces, that a Python worker remembers at least; results do not depend on it.
CACHE_UNITS = 500_000


class Memory(dict):
    """A map of bounded size: two generations, the older one is dropped when the younger is full."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units (binary), the unit codes of all texts in order, and where each text begins among them (n + 1)."""
    data, offsets = flat(texts)
    n = len(data)
    begins = np.zeros(n + 1, bool)
    if n > 1:
        begins[: n - 1] = _SPACE[data[:-1]] & _PLAIN[data[1:]]
        ends = offsets[1:][offsets[1:] > 0] - 1
        begins[ends] = False  # the next byte belongs to another text
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[filled] = True
    starts = np.flatnonzero(begins[:n])
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    coded = strings(data, starts).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, offsets)


def as_bytes(units: pa.Array) -> list[bytes]:
    at = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1].tolist() if len(units) else [0]
    raw = units.buffers()[2].to_pybytes() if len(units) else b""
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Fixed value: the splitting pattern of byte-level tokenizers that use their built-in one.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units for which the library's normalizing and splitting is done here: printable ASCII and precomposed Latin letters,
#: on which lower-casing is plain and all regular-expression engines agree.
_EASY = re.compile("[ \\n]?[!-;=-~\u00c0-\u012f\u0131-\u024f]+")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable in Latin-1,
    else the next free code point from 256 up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Splitter:
    """Units to the model's pieces, as the library's normalizer and pre-tokenizer make them."""

    def __init__(self, path: str):
        t = load(path)
        with open(path) as f:
            config = json.load(f)
        chars = byte_chars()
        self.written = {c: "".join(chars[b] for b in chr(c).encode()) for c in [*range(0x80), *range(0xC0, 0x250)]}
        self.normalize = t.normalizer.normalize_str if t.normalizer else None
        self.library = t.pre_tokenizer.pre_tokenize_str
        steps = config["pre_tokenizer"].get("pretokenizers") or [config["pre_tokenizer"]]
        split = next((x["pattern"]["Regex"] for x in steps if x["type"] == "Split"), BYTE_LEVEL_PATTERN)
        narrow = split.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"\s\p{L}\p{N}", rf"\s{_LETTERS}0-9")
        self.find = re.compile(narrow.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")).findall
        self.keeps_space = split == BYTE_LEVEL_PATTERN
        self.lower = any(x["type"] == "Lowercase" for x in (config["normalizer"] or {}).get("normalizers", []))

    def __call__(self, raw: bytes) -> list[str]:
        if raw.isascii():  # a space or line feed, letters, perhaps one full stop or comma: no search needed
            body, tail = (raw[1:-1], chr(raw[-1])) if raw[-1] in b".," else (raw[1:], "")
            if body.isalpha() and raw[0] in b" \n":
                word = body.decode()
                if not self.keeps_space:
                    return [word.lower() if self.lower else word, tail] if tail else [word.lower() if self.lower else word]
                head = [self.written[32] + word] if raw[0] == 32 else [self.written[10], word]
                return [*head, tail] if tail else head
        unit = raw.decode()
        if _EASY.fullmatch(unit):
            return [x.translate(self.written) for x in self.find(unit.lower() if self.lower else unit)]
        return [x for x, _ in self.library(self.normalize(unit) if self.normalize else unit)]


class UnitEncoder:
    """Ids of texts under the tokenizer file at ``path``, without added special tokens. The library's model runs once
    per distinct piece; units that may hold a special token go through the whole library call. Remembers ``remember``
    distinct units and as many pieces at least."""

    def __init__(self, path: str, remember: int = CACHE_UNITS):
        self.tokenizer, self.split = load(path), Splitter(path)
        self.units, self.pieces = Memory(remember), Memory(remember)
        self.model = self.tokenizer.model.tokenize

    def _unit(self, unit: bytes) -> bytes:
        if b"<|" in unit:
            ids = self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for piece in self.split(unit):
            ids = self.pieces[piece]
            if ids is None:
                found = [x.id for x in self.model(piece)]
                ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
            out.append(ids)
        return b"".join(out)

    def _ids(self, units: list[bytes]) -> list[bytes]:
        self.units.turn()
        self.pieces.turn()
        known, out = self.units, []
        for u in units:
            ids = known[u]
            if ids is None:
                ids = known[u] = self._unit(u)
            out.append(ids)
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and where each text begins (n + 1). ``end_id`` closes every text."""
        units, codes, at = cut(texts)
        raw = self._ids(as_bytes(units))
        sizes = np.fromiter((len(x) >> 2 for x in raw), np.int64, len(raw))
        pool = np.frombuffer(b"".join(raw), "<u4")
        first = np.cumsum(sizes) - sizes
        n = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[codes] - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[at]
        if end_id is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
