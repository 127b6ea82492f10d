"""Quality rules: lines labelled content or boilerplate by a linear-chain conditional random field.

Every line of a document is reduced to a bit mask of indicator features. A two-label CRF
(trained here on a bounded sample of labelled documents) scores masks and transitions,
Viterbi decoding labels the whole line sequence, and the share of words on content lines
decides whether the document stays.

Training has only document labels, so line labels are bootstrapped: a transition-free fit
to the document labels is spread over lines, then its own line labels (with licence lines
seeded as boilerplate) train the full chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import labelled_rows

CONTENT, BOILERPLATE = 1, 0
#: Most labelled documents of each class that training reads, with all their lines.
TRAIN_PER_CLASS = 1000
#: Lines of a training chain: longer documents are cut into chains of so many lines, none left out.
CHAIN_LINES = 64
#: Words on content lines over all words, from which a document stays.
CONTENT_SHARE = 0.5

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
_LEGAL = re.compile(r"licen[sc]e|all rights reserved|copyright|cookie|subscribe|privacy policy|terms of", re.I)

_GROUPS = {
    "bias": 1, "words": 5, "symbols": 4, "upper": 3, "word_length": 3, "bang": 3, "pipe": 2,
    "digits": 1, "ends": 1, "repeated_line": 1, "repeated_words": 1, "legal": 1, "first": 1, "last": 1, "url": 1,
}
_AT = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()]).tolist()))
N_FEATURES = sum(_GROUPS.values())


def _step(x: float, *edges: float) -> int:
    return sum(x > e for e in edges)


def line_masks(text: str | None) -> tuple[list[int], list[int]]:
    """Feature mask and word count of each line of the text that has a word."""
    lines = [x for x in (text or "").split("\n") if x.encode("utf-8", "replace").split()]
    seen = Counter(lines)
    masks, sizes = [], []
    for k, line in enumerate(lines):
        raw = line.encode("utf-8", "replace")
        words = raw.split()
        size = len(raw)
        n = len(words)

        def share(chars: bytes, raw=raw, size=size) -> float:
            return (size - len(raw.translate(None, chars))) / size

        bits = [
            _AT["bias"],
            _AT["words"] + _step(n, 2, 5, 15, 60),
            _AT["symbols"] + _step(share(_SYMBOLS), 0, 0.02, 0.1),
            _AT["upper"] + _step(share(_UPPER), 0.1, 0.4),
            _AT["word_length"] + _step((size - n + 1) / n, 3.5, 9),
            _AT["bang"] + _step(raw.count(b"!") / n, 0, 0.5),
            _AT["pipe"] + _step(raw.count(b"|") / n, 0.2),
        ]
        for name, on in (
            ("digits", share(_DIGIT) > 0.1),
            ("ends", raw.rstrip()[-1:] in b".?!"),
            ("repeated_line", seen[line] > 1),
            ("repeated_words", n > 8 and len(set(words)) < 0.5 * n),
            ("legal", bool(_LEGAL.search(line))),
            ("first", k == 0),
            ("last", k == len(lines) - 1),
            ("url", b"://" in raw),
        ):
            if on:
                bits.append(_AT[name])
        masks.append(sum(1 << b for b in bits))
        sizes.append(n)
    return masks, sizes


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dup, seen = 0, set()
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        times = Counter(windows)
        if len(times) < len(windows):
            covered = 0  # words up to here are counted
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    return n, chars, symbols, dup, repeated


@dataclass(frozen=True)
class LineCRF:
    """Weights of a two-label chain: emit[feature, label], step[from, to]."""

    emit: np.ndarray
    step: np.ndarray

    @classmethod
    def blank(cls) -> LineCRF:
        """Without labelled documents every line counts as content."""
        emit = np.zeros((N_FEATURES, 2))
        emit[_AT["bias"], CONTENT] = 1.0
        return cls(emit, np.zeros((2, 2)))

    def scores(self, mask: int) -> tuple[float, float]:
        on = [f for f in range(N_FEATURES) if mask >> f & 1]
        a, b = self.emit[on].sum(axis=0)
        return float(a), float(b)


def viterbi(crf: LineCRF, masks: list[int], memo: dict[int, tuple[float, float]] | None = None) -> list[int]:
    """The most likely label sequence; equal scores prefer content."""
    if not masks:
        return []
    memo = {} if memo is None else memo
    (s00, s01), (s10, s11) = crf.step.tolist()
    back: list[tuple[int, int]] = []
    a = b = None
    for m in masks:
        e = memo.get(m)
        if e is None:
            e = memo[m] = crf.scores(m)
        if a is None:
            a, b = e
            continue
        from_a, from_b = int(b + s10 >= a + s00), int(b + s11 >= a + s01)
        back.append((from_a, from_b))
        a, b = (b + s10 if from_a else a + s00) + e[0], (b + s11 if from_b else a + s01) + e[1]
    label = int(b >= a)
    out = [label]
    for choice in reversed(back):
        label = choice[label]
        out.append(label)
    return out[::-1]


def _fit(x: np.ndarray, y: np.ndarray, at: tuple[np.ndarray, np.ndarray], chain: bool, start: np.ndarray | None = None, rounds: int = 80, l2: float = 1e-3) -> LineCRF:
    """Adam on the regularised conditional log likelihood.

    x: (lines, features) and y: (lines,) of all documents; at: each line's document and place in it.
    """
    docs, places = at[0].max() + 1, at[1].max() + 1
    emit, step = np.zeros((N_FEATURES, 2)) if start is None else start.copy(), np.zeros((2, 2))
    used = np.zeros((docs, places))
    used[at] = 1
    truth = np.eye(2)[y]
    padded = np.zeros((docs, places, 2))
    padded[at] = truth
    true_steps = np.einsum("dti,dtj->ij", padded[:, :-1], padded[:, 1:]) / len(y)
    pair_used = used[:, 1:]
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]

    def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis)
        return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))

    for k in range(1, rounds + 1):
        flat = x @ emit
        grown = np.zeros_like(step)
        if chain:
            e = np.zeros((docs, places, 2))
            e[at] = flat
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, places):
                fwd[:, t] = np.where(used[:, t, None] > 0, log_sum(fwd[:, t - 1, :, None] + step, 1) + e[:, t], fwd[:, t - 1])
            for t in range(places - 2, -1, -1):
                bwd[:, t] = np.where(used[:, t + 1, None] > 0, log_sum(step + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), bwd[:, t + 1])
            z = log_sum(fwd[:, -1], 1)
            node = np.exp(np.minimum(0, fwd + bwd - z[:, None, None]))[at]
            edge = np.exp(np.minimum(0, fwd[:, :-1, :, None] + step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]))
            grown = true_steps - np.einsum("dtij,dt->ij", edge, pair_used) / len(y) - l2 * step
        else:
            node = np.exp(flat - log_sum(flat, 1)[:, None])
        slope = x.T @ (truth - node) / len(y) - l2 * emit
        for w, g, m, v in ((emit, slope, *moments[:2]), (step, grown, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineCRF(emit, step)


def train(documents: DataFrame, labels: DataFrame) -> LineCRF:
    """Fits the chain on all lines of at most TRAIN_PER_CLASS labelled documents of each quality.

    The sample is the labelled ids with the smallest hash; null labels or ids don't count,
    of repeated labels the greatest holds, of documents that repeat an id the one whose text has
    the smallest hash. Without both classes the blank chain is returned.
    """
    lines = F.pandas_udf(lambda s: s.map(lambda t: line_masks(t)[0]), "array<long>")
    rows = labelled_rows(documents, labels, TRAIN_PER_CLASS, lines)
    rows = [(r.doc_id, r.quality, r.x[k : k + CHAIN_LINES]) for r in rows for k in range(0, len(r.x), CHAIN_LINES)]
    if len({q for _, q, _ in rows}) < 2:
        return LineCRF.blank()
    masks = np.array([m for *_, ms in rows for m in ms], dtype=np.int64)
    at = (np.array([d for d, (*_, ms) in enumerate(rows) for _ in ms]), np.array([k for *_, ms in rows for k in range(len(ms))]))
    x = ((masks[:, None] >> np.arange(N_FEATURES)) & 1).astype(float)
    y = np.array([q for _, q, ms in rows for _ in ms])
    first = _fit(x, y, at, chain=False)
    e = x @ first.emit
    y = (e[:, CONTENT] >= e[:, BOILERPLATE]).astype(int)
    y[x[:, _AT["legal"]] > 0] = BOILERPLATE
    return _fit(x, y, at, chain=True, start=first.emit)


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, content_share double, kept boolean"


def judged(text: Column, crf: LineCRF, content_share: float = CONTENT_SHARE) -> Column:
    """Struct of the base counts, the words on content lines, their share and the verdict for a text column."""

    @F.pandas_udf(_RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[int, tuple[float, float]] = {}
        for texts in batches:
            out = []
            for text in texts:
                n, chars, symbols, dup, repeated = base_counts(text)
                failed = n < 50 or 100 * repeated > 50 * n
                masks, sizes = line_masks(text)
                good = sum(w for w, label in zip(sizes, viterbi(crf, masks, memo)) if label == CONTENT)
                share = good / n if n else 0.0
                out.append((n, chars, symbols, dup, repeated, failed, good, share, not failed and share >= content_share))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return judge(text)


def quality_rules(documents: DataFrame, labels: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document row: doc_id, base counts, base_failed, content_words, content_share, kept.

    Null and empty texts have no words: counts 0, base_failed true, kept false. Repeated rows
    each get their row. Other columns of the inputs are ignored. No labelled rows: every line
    is content, so the base rules alone decide. Texts of any length are read whole.
    """
    verdict = judged(F.col("text"), train(documents, labels), content_share)
    return documents.select("doc_id", "text").select("doc_id", verdict.alias("r")).select("doc_id", "r.*")


def keep_quality(documents: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns; the chain is trained on corpus and labels."""
    return documents.where(judged(documents["text"], train(corpus, labels))["kept"])


def op1_quality_rules(spark, sf_dir):
    from gridstone.llm.common import table

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", "content_share")
