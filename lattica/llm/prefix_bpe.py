"""BPE by dynamic programming over prefixes.

The encoding of a string ends in exactly one token for each of its prefixes. An automaton over the vocabulary reports
the tokens that end at every position; of these, the last token of the prefix is the only one that is compatible with
the last token of the prefix before it, where two tokens are compatible if merging their concatenation gives them back.
Back-pointers from the end then spell the ids. No merge loop runs over the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .units import CACHE_UNITS, Memory, Splitter, as_bytes, cut

#: Shift that marks the last symbol of a word, for vocabularies with a word-end suffix.
_WORD_END = 0xE000
_NEVER = 1 << 60


class PrefixBpe:
    """The model of a ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        with open(path) as f:
            config = json.load(f)
        model = config["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in config["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in config["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank, self.made = {}, {}  # pair -> rank; token -> (left, right, rank)
        suffix = len(self.suffix)
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = r
            self.made.setdefault(whole, (vocab[a], vocab[b], r))
        self.left, self.right = {}, {}  # spines: leaf first
        reachable, automaton = set(), ahocorasick.Automaton()
        for i in vocab.values():
            if i not in self.made:
                self.left[i] = self.right[i] = (i,)
                reachable.add(i)
        for whole, (a, b, _) in sorted(self.made.items(), key=lambda x: x[1][2]):
            self.left[whole], self.right[whole] = (*self.left[a], whole), (*self.right[b], whole)
            if a in reachable and b in reachable and self._meets(a, b, whole):
                reachable.add(whole)
        for t, i in vocab.items():
            if i in reachable:
                shown = self._mark(t[:-suffix]) if suffix and t.endswith(self.suffix) and len(t) > suffix else t
                automaton.add_word(shown, (len(shown), i))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.pairs = Memory(CACHE_UNITS)

    def _mark(self, word: str) -> str:
        return word[:-1] + chr(_WORD_END + ord(word[-1])) if self.suffix else word

    def _meets(self, a: int, b: int, whole: int | None = None) -> bool:
        """Whether ``a`` and ``b`` both form, side by side, before any merge joins parts of both; with ``whole``, that
        the first such merge is the one that makes it."""
        up, down, made, rank = self.right[a], self.left[b], self.made, self.rank
        i = j = 0
        while True:
            before = made[up[i + 1]][2] if i + 1 < len(up) else _NEVER
            after = made[down[j + 1]][2] if j + 1 < len(down) else _NEVER
            cross = rank.get((up[i], down[j]))
            if before == after == _NEVER:
                return cross is None or (whole is not None and cross == made[whole][2])
            # equal ranks are the same pair in a row, of which the leftmost merges first
            if cross is not None and cross < before and cross <= after:
                return False
            if before <= after:
                i += 1
            else:
                j += 1

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-tokenized piece."""
        word = self._mark(piece)
        n, pairs = len(word), self.pairs
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.matches(word):
            e, start = end + 1, end + 1 - length
            if last[e] >= 0:
                continue
            if start:
                key = last[start], token
                if key[0] < 0:
                    continue
                ok = pairs[key]
                if ok is None:
                    ok = pairs[key] = self._meets(*key)
                if not ok:
                    continue
            last[e], size[e] = token, length
        out, at = [], n
        while at:
            out.append(last[at])
            if last[at] < 0:
                raise ValueError(f"the vocabulary lacks a symbol of {piece!r}")
            at -= size[at]
        return out[::-1]


@lru_cache(maxsize=2)
def load_prefix_bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)


class Codec:
    """Whole texts to ids and back, unit by unit."""

    def __init__(self, path: str):
        self.bpe, self.split = load_prefix_bpe(path), Splitter(path)
        self.units, self.pieces = Memory(CACHE_UNITS), Memory(CACHE_UNITS)
        self.special = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")").split

    def _pieces(self, raw: bytes) -> list[int]:
        out = []
        for piece in self.split(raw):
            ids = self.pieces[piece]
            if ids is None:
                ids = self.pieces[piece] = self.bpe.encode(piece)
            out += ids
        return out

    def unit(self, raw: bytes) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals, the decoded tokens."""
        known = self.units[raw]
        if known is None:
            if b"<|" in raw:
                parts = self.special(raw.decode())
                ids = [i for k, x in enumerate(parts) for i in ([self.bpe.special[x]] if k % 2 else self._pieces(x.encode()) if x else [])]
            else:
                ids = self._pieces(raw)
            known = self.units[raw] = (len(ids), " ".join(map(str, ids)), " ".join(map(self.bpe.text.__getitem__, ids)))
        return known

    def turn(self) -> None:
        for m in (self.units, self.pieces, self.bpe.pairs):
            m.turn()


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the decimal ids joined by one space, and of the
    decoded text, which for a file without a decoder is its tokens joined by one space. Null text is empty: no ids.
    Texts of any length are encoded whole; repeated rows and ids are documents of their own. An empty table gives an empty
    result. Further columns, whatever their names, are not read."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        codec = Codec(tokenizer)
        for b in slices(batches):
            codec.turn()
            units, codes, at = cut(b.column("text"))
            got = [codec.unit(u) for u in as_bytes(units)]
            counts = np.array([x[0] for x in got], np.int64)
            full = counts[codes] > 0
            before = np.concatenate([[0], np.cumsum(full)])[at]
            n = np.concatenate([[0], np.cumsum(counts[codes])])[at]
            codes = codes[full]
            ids, shown = [], []
            for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                mine = codes[lo:hi].tolist()
                ids.append(hashlib.sha256(" ".join([got[c][1] for c in mine]).encode()).hexdigest())
                shown.append(hashlib.sha256(" ".join([got[c][2] for c in mine]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(n)), pa.array(ids), pa.array(shown)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
