"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary runs once over a split word and gives the
longest token at each of its positions. Tokens are taken greedily; a token is kept only if the pair with its predecessor
is compatible, that is, if merging the two tokens' bytes on their own would give the same two
tokens. Otherwise the next shorter token is tried and, failing that, the predecessor is given
up and its position is marked, so that each position fails once: linear time, exact merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most split words that a worker remembers (it starts anew beyond), and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64


@lru_cache(maxsize=1)
def exact_split() -> tuple[str, str]:
    """SPLIT with the tokenizers library's letters, numbers and spaces, and the class of characters where it matters.

    The two libraries know different editions of Unicode. All code points of one class here are
    shown to the other library's splitter in one string, which cuts it wherever it sees another
    class; one question a cut-out run tells which. Texts without any character of the second pattern are
    split by SPLIT alone.
    """
    import regex
    from tokenizers import pre_tokenizers

    theirs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in " '")
    here = {k: regex.findall(r, every) for k, r in (("L", r"\p{L}"), ("N", r"\p{N}"), ("Z", r"\s"), ("O", r"[^\s\p{L}\p{N}]"))}

    def kind_there(c: str) -> str:
        for k, before in (("L", "a"), ("N", "1"), ("O", "!")):
            if len(theirs.pre_tokenize_str(before + c)) == 1:
                return k
        return "Z"

    add: dict[str, list[str]] = {k: [] for k in "LNZO"}
    drop: dict[str, list[str]] = {k: [] for k in "LNZO"}
    for k, chars in here.items():
        text = "".join(chars)
        for _, (a, b) in theirs.pre_tokenize_str(text):
            found = kind_there(text[a])
            if found != k:
                add[found] += text[a:b]
                drop[k] += text[a:b]

    def listed(chars: list[str]) -> str:
        codes = np.sort(np.fromiter(map(ord, chars), dtype=np.int64, count=len(chars)))
        runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
        return "".join(f"\\U{r[0]:08X}-\\U{r[-1]:08X}" for r in runs if len(r))

    def as_class(base: str, k: str) -> str:
        return "[" + base + (f"||[{listed(add[k])}]" if add[k] else "") + (f"--[{listed(drop[k])}]" if drop[k] else "") + "]"

    letter, number, space = as_class(r"\p{L}", "L"), as_class(r"\p{N}", "N"), as_class(r"\s", "Z")
    moved = [c for chars in drop.values() for c in chars]
    whole = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{space}{letter}{number}]+|{space}+(?![^{space}])|{space}+"
    return whole, f"[{listed(moved)}]" if moved else r"(?!)"


def byte_characters() -> dict[str, int]:
    """The vocabulary's characters for bytes: printable Latin-1 as itself, the others from U+0100 on, in byte order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """A vocabulary file's merges as matching, compatibility and offset tables."""

    def __init__(self, vocabulary: str, split: tuple[str, str] | None = None):
        import ahocorasick
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_characters()
        ids = {bytes(byte[c] for c in token): n for token, n in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = ids
        self.bytes = {n: token for token, n in ids.items()}
        self.size = {n: len(token) for n, token in self.bytes.items()}
        self.parts = {n: (n, n) for n in self.bytes}
        self.rank = {n: -1 for n in self.bytes}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(byte[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[left + right]
            self.pairs[ids[left], ids[right]] = whole
            if self.rank[whole] < 0:
                self.parts[whole], self.rank[whole] = (ids[left], ids[right]), rank
        self.match = ahocorasick.Automaton()
        for token, n in ids.items():
            self.match.add_word(token.decode("latin-1"), n)
        self.match.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        whole, moved = split or exact_split()
        self.split, self.split_moved, self.moved = regex.compile(SPLIT), regex.compile(whole), re.compile(moved)
        self.moved_from = min((int(x, 16) for x in re.findall(r"\\U([0-9A-F]{8})", moved)), default=1 << 21)  # the least of those characters
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        top = max([*self.bytes, *self.special.values()]) + 1
        table = [self.bytes.get(n, b"") for n in range(top)]
        for token, n in self.special.items():
            table[n] = token.encode()
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self._words: dict[str, tuple[bytes, str]] = {}

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            whole = self.bytes[token]
            self.shorter[token] = next((self.ids[whole[:k]] for k in range(len(whole) - 1, 0, -1) if whole[:k] in self.ids), None)
        return self.shorter[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together.

        Undoes the latest merge on either side of the border, again and again; a merge across
        the border that comes before the last one undone would have swallowed it.
        """
        key = (left, right)
        ranks, parts, pairs = self.rank, self.parts, self.pairs
        undone = (1 << 60, 0)
        answer = None
        while answer is None:
            across = pairs.get((left, right))
            if across is not None and (ranks[across], 0) < undone:
                answer = False
            elif ranks[left] < 0 and ranks[right] < 0:
                answer = True
            elif ranks[left] > ranks[right]:
                undone, left = (ranks[left], 0), parts[left][1]
            else:
                undone, right = (ranks[right], 1), parts[right][0]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def longest_matches(self, raw: bytes) -> list[int]:
        """The longest token that starts at each byte, from one run of the automaton."""
        found, size = [0] * len(raw), self.size
        for end, token in self.match.iter(raw.decode("latin-1")):
            found[end + 1 - size[token]] = token  # a start's matches come by ascending end
        return found

    def encode_word(self, raw: bytes) -> list[int]:
        """Token ids of one split word."""
        n = len(raw)
        if n == 1:
            return [self.ids[raw]]
        size, known, compatible, shorter_of = self.size, self.compatible.get, self._compatible, self.shorter
        longest = self.longest_matches(raw)
        closed = set()
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if end not in closed and (not out or (ok if (ok := known((out[-1], token))) is not None else compatible(out[-1], token))):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            shorter = shorter_of[token] if token in shorter_of else self._shorter(token)
            if shorter is not None:
                token = shorter
                continue
            closed.add(at)
            token = out.pop()
            at -= size[token]

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word.encode())
        found = (struct.pack(f"<{len(ids)}I", *ids), ",".join(map(str, ids)))
        if len(word) <= REMEMBERED_CHARS:
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            self._words[word] = found
        return found

    def _stretches(self, text: str) -> Iterator[tuple[str, int | None]]:
        if self.at_special is None or not any(s in text for s in self.special):
            yield text, None
            return
        at = 0
        for m in self.at_special.finditer(text):
            yield text[at : m.start()], self.special[m.group()]
            at = m.end()
        yield text[at:], None

    def _splitter(self, stretch: str):
        """The expression that cuts a stretch as the library does; the slower one only where a character needs it."""
        if stretch.isascii() or int(np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), dtype="<u4").max()) < self.moved_from:
            return self.split
        return self.split_moved if self.moved.search(stretch) else self.split

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids as an array and as decimals joined by commas."""
        raw, shown = [], []
        for stretch, special in self._stretches(text):
            get, new = self._words.get, self._word
            found = [get(word) or new(word) for word in self._splitter(stretch).findall(stretch)]
            raw += [x[0] for x in found]
            shown += [x[1] for x in found]
            if special is not None:
                raw.append(np.array([special], dtype="<u4").tobytes())
                shown.append(str(special))
        return np.frombuffer(b"".join(raw), dtype="<u4"), ",".join(shown)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from one table by offset."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)].tobytes()


@lru_cache(maxsize=2)
def tables_of(vocabulary: str, split: tuple[str, str]) -> ByteBPE:
    """A vocabulary's tables, built once a worker, whatever number of tasks it runs; what it remembers is bounded."""
    return ByteBPE(vocabulary, split)


def encoded(text: Column, vocabulary: str) -> Column:
    """array<int> of token ids; null text as empty."""
    split = exact_split()

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tables_of(vocabulary, split)
        for texts in batches:
            yield pd.Series([bpe.encode(t or "")[0].astype("int32") for t in texts])

    return run(text)


def decoded(ids: Column, vocabulary: str) -> Column:
    """Text of an array of token ids; bytes that are no UTF-8 become U+FFFD; null as empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tables_of(vocabulary, (SPLIT, r"(?!)"))  # decoding splits nothing
        for arrays in batches:
            yield pd.Series([bpe.decode([] if a is None else a).decode("utf-8", "replace") for a in arrays])

    return run(ids)


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trips(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256, of ids that were encoded and then decoded.

    Null and empty texts have no tokens (hashes of nothing). Special tokens' strings in a text
    are those tokens. Repeated rows and null ids each get their row; an empty table gives none.
    """
    split = exact_split()

    @F.pandas_udf(_DIGEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tables_of(vocabulary, split)
        for texts in batches:
            out = []
            for text in texts:
                ids, shown = bpe.encode(text or "")
                back = bpe.decode(ids).decode("utf-8", "replace").encode()
                out.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table
    from gridstone.llm.packing import vocabulary_path

    return round_trips(table(spark, sf_dir, "documents"), vocabulary_path())
