"""BPE encoding by one pass of dynamic programming over the prefixes of a word.

The merge encoding of a string has, for each of its prefixes, one last token: the only token that ends the prefix,
leaves a prefix whose own last token is known, and is compatible with that token (merging the two tokens' characters
gives just these two). An automaton over the vocabulary lists the tokens that end at each position; compatible ones are
stored, and following the last tokens back from the end gives the ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Words and token pairs kept per task. Of words a full table becomes the older of two, where seen words are found again;
#: one of pairs is emptied. Both only cost time.
WORD_CACHE, PAIR_CACHE = 400_000, 500_000
#: Added to the code point of a word's last character, which the vocabulary tells apart.
_LAST = 0x1000
_SUFFIX = "</w>"
#: White space as the tokenizer's patterns have it, and what only str.split() takes for it.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_NO_SPACE = re.compile("[\\x1c-\\x1f]")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stay, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A lower-casing byte-level BPE with word ends, read from a tokenizer file of that kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or spec["decoder"] is not None:
            raise ValueError("not a word-end BPE without decoder")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: token for token, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.tokens = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        symbols = byte_characters()
        self.inner = symbols
        self.last = [chr(ord(s) + _LAST) for s in symbols]

        ids = {self._spelled(token): i for token, i in model["vocab"].items()}
        self.single = {s: i for s, i in ids.items() if len(s) == 1}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = [-1] * len(self.tokens)
        for rank, pair in enumerate(model["merges"]):
            left, right = (self._spelled(p) for p in (pair if isinstance(pair, list) else pair.split(" ")))
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.rank[pair] = rank
            if made not in self.parts:
                self.parts[made], self.born[made] = pair, rank
        self.automaton = ahocorasick.Automaton()
        for spelled, i in ids.items():
            if len(spelled) == 1 or i in self.parts:
                self.automaton.add_word(spelled, (i, len(spelled)))
        self.automaton.make_automaton()
        self._ends = [self._spine(i, 1) for i in range(len(self.tokens))]
        self._starts = [self._spine(i, 0) for i in range(len(self.tokens))]
        self._pairs: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _spelled(self, token: str) -> str:
        """One character per byte; the last one of a word's end is shifted."""
        if token.endswith(_SUFFIX) and token != _SUFFIX:
            stem = token[: -len(_SUFFIX)]
            return stem[:-1] + chr(ord(stem[-1]) + _LAST)
        return token

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its parts on one side, each with the rank of the merge that uses it up."""
        out, end = [(token, len(self.rank))], token
        while end in self.parts:
            out.append((self.parts[end][side], self.born[end]))
            end = self.parts[end][side]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the characters of both tokens merge into just these two.

        Merges happen by ascending rank, the leftmost first. Two parts that meet at the border would merge if their
        rank comes before either is used up; at equal rank the part on the left side is used up first, the one on the
        right side is not.
        """
        get = self.rank.get
        for a, a_used in self._ends[left]:
            for b, b_used in self._starts[right]:
                rank = get((a, b))
                if rank is not None and rank < a_used and rank <= b_used:
                    return False
        return True

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one spelled word."""
        last = [-1] * (len(symbols) + 1)
        back = [0] * (len(symbols) + 1)
        pairs = self._pairs
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                pair = last[start] << 20 | token
                known = pairs.get(pair)
                if known is None:
                    if len(pairs) >= PAIR_CACHE:
                        pairs.clear()
                    known = pairs[pair] = self.compatible(last[start], token)
                if not known:
                    continue
            last[end], back[end] = token, start
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _spaced(self, spaced: str) -> bytes:
        """Ids of what stands between white space, from the older table or anew."""
        ids = self._older.get(spaced)
        if ids is None:
            pieces = self.specials.split(spaced) if self.specials and "<|" in spaced else [spaced]
            ids = b""
            for piece in pieces:
                if piece in self.special:
                    ids += array("i", [self.special[piece]]).tobytes()
                    continue
                for word in self.words.findall(self.normal(piece)):
                    ids += self._word(word)
        self._keep(spaced, ids)
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of one normal word; where it stands alone it has the same ids, so one table holds both."""
        ids = self._cache.get(word) or self._older.get(word)
        if ids is None:
            raw, inner = word.encode("utf-8"), self.inner
            symbols = "".join([inner[b] for b in raw[:-1]]) + self.last[raw[-1]]
            ids = array("i", self.encode_symbols(symbols)).tobytes()
            self._keep(word, ids)
        return ids

    def _keep(self, text: str, ids: bytes) -> None:
        if len(self._cache) >= WORD_CACHE:
            self._older, self._cache = self._cache, {}
        if len(text) <= 64:
            self._cache[text] = ids

    def normal(self, text: str) -> str:
        """Composed and lower case, character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the strings of special tokens become their ids.

        No word holds white space and no character joins with it, so texts are cut there before anything else.
        """
        spaced = text.split() if not _NO_SPACE.search(text) else _SPACE.split(text)
        get, new = self._cache.get, self._spaced
        out = []
        for x in spaced:
            ids = get(x)
            if ids is None:
                ids = new(x)
                get = self._cache.get
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, special ones too, with a space between: the file has no decoder."""
        return " ".join(self.tokens[ids].tolist())


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) and ``decoded`` (the text that these ids decode to).

    Null and empty texts have no ids and an empty decoded text. Columns of these two names are replaced, all others
    stay. ``path`` is read on each executor.
    """
    kept = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text_col):
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(text_col)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = pa.array(np.concatenate(ids), type=pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), flat)
            decoded = pa.array([bpe.decode(x) if len(x) else "" for x in ids], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], names=[*kept, "token_ids", "decoded"])

    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("token_ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return docs.mapInArrow(run, schema)
