"""The pipeline's near-duplicate stage against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import wide_simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """Position of the first text of each one's group."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect())


def edited(random, words, similarity):
    """A copy in which so many words change, far apart, that about this similarity is left."""
    out, n = list(words), len(words) - 4
    changes = int(n * (1 - similarity) / (1 + similarity) / 5)
    for at in random.choice(np.arange(1, len(words) // 6), changes, False) * 6:
        out[at] = f"x{random.integers(1 << 40)}"
    return out


def test_stage_finds_all_from_080_on(spark):
    random, texts = np.random.default_rng(7), []
    for i in range(120):
        words = [f"w{x}" for x in random.integers(0, 5000, 400)]
        texts += [" ".join(words), " ".join(edited(random, words, (0.7, 0.78, 0.805, 0.83, 0.9, 0.95)[i % 6]))]
    wanted = groups(texts)
    assert 70 < sum(a != i for i, a in enumerate(wanted)) < 110  # the others are below 0.8 and must stay
    assert kept(spark, texts) == sorted(set(wanted))


def test_stage_joins_a_group_without_a_middle(spark):
    """Each text is like the next only; and a group of near copies around one text."""
    random = np.random.default_rng(8)
    words = [f"w{x}" for x in range(300)]
    chain = [" ".join(words[i * 15 : i * 15 + 200]) for i in range(6)]
    star = [f"c{x}" for x in random.integers(0, 5000, 300)]
    texts = [*chain, *(" ".join(edited(random, star, 0.85)) for _ in range(40))]
    assert kept(spark, texts) == sorted(set(groups(texts)))


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(250).select(F.col("doc_id"), "text").collect()
    assert kept(spark, [r["text"] for r in docs]) == sorted(set(groups([r["text"] for r in docs])))


def test_repeated_shingles_do_not_link(spark):
    """Two texts with one much repeated shingle and otherwise different words."""
    texts = ["the same words again and " * 200 + " ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    assert kept(spark, texts) == [0, 1]


@pytest.mark.parametrize("text", ["", None, "one", "one two three four five six"])
def test_short_texts(spark, text):
    assert kept(spark, [text, text, "other words"]) == [0, 2]
    assert rows(wide_simhash.deduplicated(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_a_large_group_is_contracted_before_its_pairs_are_compared(spark, monkeypatch):
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(240)]
    texts = []
    for i in range(150):
        words = list(base)
        words[draw.integers(0, 240)] = f"x{i}"
        texts.append((i, " ".join(words)))
    asked, confirmed = [], wide_simhash.confirmed
    monkeypatch.setattr(wide_simhash, "confirmed", lambda pairs, sets: asked.append(pairs.count()) or confirmed(pairs, sets))
    assert wide_simhash.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).count() == 1
    assert asked[0] <= 150, asked


def test_unlinked_near_copies_are_not_all_listed(spark, monkeypatch):
    """A group mostly below the least similarity: its pairs are compared, but don't become rows."""
    draw = np.random.default_rng(6)
    base, texts = [f"w{i}" for i in range(500)], []
    for i in range(200):
        words = list(base)
        for at in draw.choice(96, 7, False):
            words[at * 5 + 2] = f"x{i}"
        texts.append(" ".join(words))
    asked, confirmed = [], wide_simhash.confirmed
    monkeypatch.setattr(wide_simhash, "confirmed", lambda pairs, sets: asked.append(pairs.count()) or confirmed(pairs, sets))
    monkeypatch.setattr(wide_simhash, "CELL_SETS", 30)
    wanted = sorted(set(groups(texts)))
    assert 1 < len(wanted) < 180
    assert kept(spark, texts) == wanted
    assert sum(asked) < 1500, asked  # of 19,900


def test_fingerprints_and_parts_are_joined_once_a_set(spark, monkeypatch):
    """Sets of a large group share many full blocks; joins on the set must not make a row for each of them."""
    draw = np.random.default_rng(9)
    base, texts = [f"w{i}" for i in range(300)], []
    for i in range(60):
        words = list(base)
        for at in draw.choice(59, 3 + i % 6, False):
            words[at * 5 + 2] = f"x{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{x}" for x in draw.integers(0, 5000, 100)) for _ in range(20)]
    made, written = {}, wide_simhash.written
    wanted = sorted(set(groups(texts)))
    monkeypatch.setattr(wide_simhash, "written", lambda df, name: made.setdefault(name, []).append(written(df, name)) or made[name][-1])
    assert kept(spark, texts) == wanted
    crowded = made["members"][0].where(F.col("n") > wide_simhash.FEW)
    assert crowded.count() > 240  # rows of sets in full blocks, three a set at least
    assert made["full"][0].count() == crowded.select("node").distinct().count() <= 80


def test_a_cell_joins_its_parts_up():
    sets = [np.arange(100), np.arange(100), np.arange(5, 105), np.arange(40, 140), np.arange(60, 160)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    fp = np.packbits(wide_simhash.majorities(wide_simhash.mix(np.concatenate(sets).astype(np.uint64)), at), axis=1).view(">u8").astype(np.uint64)
    table = {"node": [1, 1, 2, 3, 4], "part": [1, 1, 2, 3, 4], "largest": [2] * 5, "size": [100] * 5, "first": [True, False, False, False, False]}
    table |= {"fp": [x.view(np.int64).tolist() for x in fp], "shingles": [s.tolist() for s in sets]}
    assert wide_simhash.cell_links(pa.table(table)).to_pylist() == [{"u": 1, "v": 2}]
