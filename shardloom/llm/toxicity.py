"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: lower case, look-alike letters of other scripts and full-width forms to Latin,
digits and signs that stand for letters inside words to those letters, joiners dropped.
The lexicon is learned: terms and word beginnings that labelled rows show in toxic texts far
more often; a weight is a term's log odds.  Terms match at the start of a word; whole-word
terms must also end there.  A match that begins inside an exception phrase doesn't count.  The
weighted sum is divided by the square root of the text's length over ``LONG`` and a logistic
curve, fitted on the same rows, makes it a score.

Learning reads a bounded sample of labelled rows (``quality.sample``: ``SAMPLE_ROWS`` ids and its bytes of text), whose
terms all count; scoring reads every
text whole, in a time that grows with its length.  Nulls: a null text is empty, its score is
that of no match.  Without labels of both kinds fixed seed terms and a default curve are used.  Empty tables give empty results; rows that
repeat a doc_id are scored each; other columns of either table, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, mapped, table, text_of
from .quality import sample

SAMPLE_ROWS = 8000
#: A learned term occurs in so many toxic texts, and its log odds are at least this.
LEAST_DOCS, LEAST_ODDS = 6, 4.0
STEMS, STEM_WORDS = range(4, 8), 3
#: Terms for use without labels, and phrases in which such words are harmless.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
EXCEPTIONS = ("clown fish", "clown nose", "pathetic fallacy", "pond scum", "sore loser", "trash bag", "trash bin", "trash can", "trash collection", "worthless cheque")
#: Characters that look like Latin letters, and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
JOINERS = "­​‌‍⁠﻿"
SEED_WEIGHT, MOST_WEIGHT, DEFAULT_CURVE, LONG = 4.0, 6.0, (1.5, -3.0), 1000

_MARKS = re.compile("[" + re.escape("".join(LEET)) + "]")
_PARTS = re.compile(r"[^\W_]+")
_TABLE = str.maketrans({**LOOKALIKES, **{chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}, **dict.fromkeys(JOINERS)})
_LEET = str.maketrans(LEET)


def foldings(text: str) -> list[str]:
    """The folded text, and where signs stand in it also with these as letters; both are of one length."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    return [text, text.translate(_LEET)] if _MARKS.search(text) else [text]


@dataclass
class Lexicon:
    weights: dict[str, float]  # a term that ends in * matches the beginning of a word
    curve: tuple[float, float] = DEFAULT_CURVE
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    @property
    def machine(self):  # noqa: ANN201
        if self._machine is None:
            import ahocorasick

            entries: dict[str, list[tuple[int, str, float]]] = {}
            for term, weight in self.weights.items():
                entries.setdefault(term.rstrip("*"), []).append((len(term.rstrip("*")), "beginning" if term[-1] == "*" else "word", weight))
            for phrase in self.exceptions:
                entries.setdefault(phrase, []).append((len(phrase), "exception", 0.0))
            self._machine = ahocorasick.Automaton()
            for key, value in entries.items():
                self._machine.add_word(key, value)
            self._machine.make_automaton()
        return self._machine

    def matches(self, text: str) -> dict[int, float]:
        """Start and weight of the words that match and stand in no exception phrase."""
        words: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for form in foldings(text) if self.weights else ():
            for end, found in self.machine.iter(form):
                for length, kind, weight in found:
                    start = end + 1 - length
                    if start and form[start - 1].isalnum() or kind != "beginning" and end + 1 < len(form) and form[end + 1].isalnum():
                        continue
                    if kind == "exception":
                        spared.append((start, end))
                    else:
                        words[start] = max(words.get(start, 0.0), weight)
        return _outside(words, spared) if spared else words

    def strength(self, text: str) -> float:
        """The sum of the weights, lowered for long texts."""
        return sum(self.matches(text).values()) / math.sqrt(1 + len(text) / LONG)

    def score(self, text: str) -> float:
        slope, shift = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * self.strength(text) + shift))))


def _outside(words: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """The words that begin in none of the spans, in one sweep over both in order."""
    spans, at, reach, out = sorted(spared), 0, -1, {}
    for start in sorted(words):
        while at < len(spans) and spans[at][0] <= start:
            reach = max(reach, spans[at][1])
            at += 1
        if start > reach:
            out[start] = words[start]
    return out


def _terms(text: str, wanted: dict | None = None) -> set[str]:
    words = set(_PARTS.findall(foldings(text)[-1]))
    stems = {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}
    return (words | stems) if wanted is None else {x for x in words | stems if x in wanted}


def learn(texts: list[str], labels: list[int]) -> Lexicon:
    """Learned terms and the curve; without texts of both kinds the seed terms."""
    weights: dict[str, float] = {}
    rows = sorted(set(zip(texts, labels, strict=True)))  # equal texts count once
    toxic, clean = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    if not toxic or not clean:
        return Lexicon(dict.fromkeys(SEEDS, SEED_WEIGHT))
    inside, words_of_stem = Counter(), {}
    for text in toxic:
        found = _terms(text)
        inside.update(found)
        for w in found:
            if w[-1] != "*":
                for k in STEMS:
                    if len(w) > k:
                        words_of_stem.setdefault(w[:k] + "*", set()).add(w)
    inside = {t: n for t, n in inside.items() if n >= LEAST_DOCS and (t[-1] != "*" or len(words_of_stem.get(t, ())) >= STEM_WORDS)}
    outside = Counter()
    for text in clean:
        outside.update(_terms(text, inside))
    odds = {t: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((outside[t] + 0.5) / (len(clean) + 1)) for t, n in inside.items()}
    strong = sorted((t for t in odds if odds[t] >= LEAST_ODDS), key=lambda t: (t[-1] != "*", len(t), t))
    taken: set[str] = set()
    for term in strong:  # the shortest beginnings first; what begins with one is covered by it
        bare = term.rstrip("*")
        if not any(bare[:k] in taken for k in STEMS if k <= len(bare)):
            weights[term] = min(MOST_WEIGHT, odds[term])
            if term[-1] == "*":
                taken.add(bare)
    lexicon = Lexicon(weights)
    x = np.array([lexicon.strength(t) for t, _ in rows])
    return Lexicon(weights, _curve(x, np.array([y for _, y in rows], float)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, with a small ridge."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.array([0.1, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 0.05 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of a bounded sample

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), fn, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(*sample(docs, table(spark, sf_dir, "labels"), "toxic", fold(5) != 0, SAMPLE_ROWS))
    return scored(docs, lexicon).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
