"""Collocations against SQL and a plain count; parts of the relations on their own."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from oracle import canonical

from shardloom.llm import collocations as C


def plain(table, top, longest, least, cover):
    counts, n = {}, Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= cover * f[p[i : i + m]]}
        ranked = []
        for p, a in found.items():
            if p not in covered:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table():
    draw = random.Random(3)
    words = ["New", "york", "city", "the", "of", "é", "漢字", "a\x00b", "x", "y"]
    out = [(draw.choice(["en", "fr", None, "und"]), "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(draw.randrange(1, 60)))) for _ in range(300)]
    return out + [("en", None), ("en", ""), ("de", "ha " * 500), ("de", "ha ho " * 300 + "!"), ("fr", "new york city. " * 50)] * 2


@pytest.mark.parametrize(("top", "longest", "least", "cover"), [(2000, 4, 30, 80), (7, 4, 5, 50), (2000, 2, 1, 80), (2000, 3, 10, 100)])
def test_equals_plain_count(spark, table, top, longest, least, cover):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(table)], "doc_id long, lang string, text string, word string, key int").repartition(5)
    assert rows(C.collocations(df, top, longest, least, cover)) == plain(table, top, longest, least, cover)


def test_sql_on_awkward_rows(spark, table):
    df = spark.createDataFrame(table, "lang string, text string")
    documents = df.toPandas()  # noqa: F841  DuckDB reads it by name
    assert canonical(C.collocations(df).toPandas()) == canonical(duckdb.connect().sql(C.SQL).df())


def test_a_full_filter_and_small_parts_change_nothing(spark, table, monkeypatch):
    monkeypatch.setattr(C, "MOST_BITS", 64)
    monkeypatch.setattr(C, "ROW_WORDS", 2)
    monkeypatch.setattr(C, "ROWS", 3)
    monkeypatch.setattr(C, "PORTION", 40)
    monkeypatch.setattr(C, "GATHERED", 20)
    filter_of = C.bit_filter
    monkeypatch.setattr(C, "bit_filter", lambda t, k: filter_of(t, k, 64))  # lets nearly all pass
    df = spark.createDataFrame(table, "lang string, text string")
    assert rows(C.collocations(df, 50, 4, 20)) == plain(table, 50, 4, 20, 80)


def test_packed_rows_hold_whole_pieces():
    slot = np.array([1, 2, 3, 5, 6, 9, 10, 11, 14])
    word, live = np.arange(9, dtype=np.uint64), np.array([1, 0, 1, 1, 0, 0, 1, 1, 1], bool)
    C.ROW_WORDS, before = 2, C.ROW_WORDS
    try:
        batches = list(C.packed(slot, word, live))
    finally:
        C.ROW_WORDS = before
    assert sum(b.num_rows for b in batches) == 4
    s, w, on = next(C.unpacked(iter(batches)))
    assert (np.diff(s) == 1).tolist() == (np.diff(slot) == 1).tolist()
    assert (w == word).all() and (on == live).all()


def test_words_that_share_a_hash_take_another(spark, monkeypatch):
    words, tried = C.words_of, []

    def clashing(texts, lut, seed):
        found = words(texts, lut, seed)
        if seed == C.SEED:
            found.key[:] = 7
        return found

    counted = C.word_counts

    def once(docs, seed):
        tried.append(seed)
        first = docs.sparkSession.createDataFrame([("en", "a", 7, 1), ("en", "b", 7, 1)], "lang string, word string, key long, n long")
        return first if seed == C.SEED else counted(docs, seed)

    monkeypatch.setattr(C, "words_of", clashing)
    monkeypatch.setattr(C, "word_counts", once)
    df = spark.createDataFrame([("en", "a b. " * 40)], "lang string, text string")
    assert rows(C.collocations(df)) == [("en", 1, "a b", 40, 40, 40, 80, 1_000_000)]
    assert tried == [C.SEED, C.SEED + 1]


def test_long_text_and_empty_table(spark):
    long = "one two three. " * 400_000
    df = spark.createDataFrame([("en", long)], "lang string, text string")
    assert rows(C.collocations(df)) == [("en", 1, "one two three", 400_000, 400_000, 400_000, 1_200_000, 1_000_000)]
    assert rows(C.collocations(df.where("false"))) == []


def test_portions_cut_after_breaks():
    text = "äb c. " * 1_000_000
    parts = [p[0].as_py() for p in C.portions(pa.array([text], pa.large_string()))]
    assert len(parts) > 1 and "".join(parts) == text and all(p.endswith(".") for p in parts[:-1])


def test_numbers_of_words_are_shuffled(spark, table, monkeypatch):
    """Few columns in the shuffle, rare words dropped before it, and the same result where words have no numbers."""
    words = np.array([3, 5, 1 << 63], np.uint64)
    rows_of = np.array([[5, 3, 1 << 63], [3, 4, 5]], np.uint64)
    coded, known = C.numbers(rows_of, words)
    assert coded.shape == (1, 2) and known.tolist() == [True, False]
    assert C.spelled_out(coded, 3, words).tolist() == rows_of[:1].tolist()
    df = spark.createDataFrame(table, "lang string, text string")
    monkeypatch.setattr(C, "MOST_NUMBERED", 0)
    assert rows(C.collocations(df, 50, 4, 20)) == plain(table, 50, 4, 20, 80)
