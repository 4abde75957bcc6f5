"""Rows that repeat ids or texts, names that clash, lists without caps, letters of newer Unicode tables."""

import random
import sys
import unicodedata

import duckdb
import numpy as np
import pytest
from conftest import rows
from oracle import canonical
from pyspark.sql import functions as F

from shardloom.llm import decontamination, exact_dedup, lm_scoring, mixing, quality, simhash, token_files, toxicity


def test_one_row_of_a_text_stays(spark):
    documents = spark.createDataFrame([(None, "x"), (None, "x"), (1, "ab"), (1, "a b"), (2, "a b"), (3, "q"), (3, "q"), (3, "q "), (4, None), (5, "")], "doc_id long, text string")
    found = exact_dedup.mark_duplicates(documents)
    kept = [(r["doc_id"], r["group_size"]) for r in found.where("kept").collect()]
    assert sorted(kept, key=repr) == [(1, 3), (3, 3), (4, 2), (None, 2)]
    documents = documents.toPandas()  # noqa: F841  DuckDB reads it by name
    assert canonical(found.toPandas()) == canonical(duckdb.connect().sql(exact_dedup.SQL).df())


def test_one_row_stays_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    mark = lambda *r: sorted(((x["doc_id"], x["keep_id"], x["kept"]) for x in exact_dedup.mark_duplicates(spark.createDataFrame(list(r), "doc_id long, text string"), index).collect()), key=repr)
    first = mark((1, "a b"), (2, "ab"))
    assert first == [(1, 1, True), (2, 1, False)]
    assert mark((1, "a b"), (2, "ab")) == first  # marked anew
    # A later batch has longer texts of a known digest, and the row that stays twice: once more, it is kept once.
    assert mark((9, "a  b"), (1, "a b"), (1, "a b"), (7, "new"), (7, "new")) == [(1, 1, False), (1, 1, True), (7, 7, False), (7, 7, True), (9, 1, False)]
    assert index.rows().count() == 2


def test_compaction_into_a_used_path_is_refused(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    index.add(exact_dedup.digests(spark.createDataFrame([(i, f"text {i}") for i in range(3)], "doc_id long, text string")))
    new = index.compacted()
    for path in (new.path, index.path):
        with pytest.raises(ValueError, match="index already"):
            index.compacted(path)
    assert new.rows().count() == index.rows().count() == 3


@pytest.mark.parametrize("ids", ["none", "one"])
def test_a_source_without_ids_comes_near_its_target(spark, ids):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i)))
    doc_id = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(None if ids == "none" else 7))
    docs = spark.range(4_000).select(doc_id.cast("long").alias("doc_id"), text.alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    got = mixing.plan(docs).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert got and all(abs(r["taken"] - r["target"]) < 0.05 * r["target"] for r in got)
    assert mixing.mixed(docs).count() * 10 == mixing.plan(docs).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]


def test_sampling_takes_any_names(spark):
    docs = spark.createDataFrame([(i, f"good text {i}" if i % 2 else f"bad bad {i}", 1, 2, 3, "t") for i in range(60)], "doc_id long, text string, __id int, __label int, hash int, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 2, 0, 0, "x") for i in range(60)], "doc_id long, quality int, toxic int, __id int, __label int, text string")
    texts, values = quality.sample(docs, labels, "quality", F.lit(True))
    assert len(texts) == 60 and all(("good" in t) == bool(y) for t, y in zip(texts, values, strict=True))
    kept = quality.accepted(docs, quality.train(texts, values))
    assert kept.columns == docs.columns and kept.count() > 0


def plain_scores(model, texts):
    """The score of each text by itself, word by word and character by character."""
    out = []
    for text in texts:
        buckets, n = quality.features(quality.pa.array([text], quality.pa.large_string()))[0].tolist(), 0
        total = 0.0
        for b in buckets:
            total, n = total + float(model.weight[b]), n + 1
        out.append(1 / (1 + np.exp(-np.clip(total / max(1, n) + model.bias, -30, 30))))
    return out


def test_batched_scores_equal_single_ones(monkeypatch):
    draw = random.Random(1)
    words = ["one", "two", "two", "éß", "漢字", "!?", "x" * 30, ""]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(40))) for _ in range(200)] + ["", " "]
    model = quality.train(texts[:80], [len(t) % 2 for t in texts[:80]])
    whole = model.scores(quality.pa.array(texts, quality.pa.large_string()))
    assert np.allclose(whole, plain_scores(model, texts), rtol=1e-9, atol=1e-12)


def test_no_cap_on_learned_terms():
    words = [f"q{a}{b}{c}" for a in "abcdefghijklmnopqrst" for b in "aeiouvwxyz" for c in "abcdefghijklm"]
    words = [w[::-1] for w in words]  # no common beginnings
    draw = random.Random(0)
    toxic = [" ".join([*draw.sample(words, 900), "longestword"]) for _ in range(60)]
    lexicon = toxicity.learn([*toxic, *(f"clean text {i}" for i in range(200))], [1] * 60 + [0] * 200)
    covered = lambda w: any(t.rstrip("*") == w or t[-1] == "*" and w.startswith(t[:-1]) for t in lexicon.weights)
    assert len(words) == 2_600 and all(covered(w) for w in [*words, "longestword"])


def test_every_character_is_encoded_as_the_library_does():
    import public_tokenizers

    e = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER))
    points = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    unknown = [c for c in points if unicodedata.category(chr(c)) == "Cn"]
    chosen = [0x0C5C, 0x088F, *unknown[:3_000], *random.Random(2).sample(unknown, 3_000), *random.Random(3).sample(points, 6_000)]
    texts = [f"1{chr(c)}'s a {chr(c)}b" for c in chosen]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, hex(ord(text[1]))


def test_rows_of_one_id_with_other_texts_draw_apart(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "s") for i in range(50)], "doc_id long, text string, source string")
    assert docs.select(mixing.draw().alias("d")).distinct().count() == 50
    assert rows(mixing.mixed(docs)) == rows(mixing.mixed(docs.repartition(3)))


def brute_links(values, distance=4):
    found = np.array(sorted(values), np.uint64)
    root = {int(v): int(v) for v in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(found):
        for w in found[i + 1 :][np.bitwise_count(found[i + 1 :] ^ v) <= distance]:
            a, b = find(int(v)), find(int(w))
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("n", [100, 5_000_000, 2**40])
def test_full_buckets_are_split(spark, n, monkeypatch):
    """Fingerprints with common high bits, a few of them linked, beside a dense group: no bucket costs its square."""
    draw = random.Random(4)
    high = 0x5A5A5A5 << 36
    values = {high | draw.getrandbits(36) for _ in range(1_400)}
    base = sorted(values)[:31]
    values |= {v ^ (1 << draw.randrange(20)) ^ (1 << 21 + draw.randrange(10)) for v in base}  # true links
    values |= {high ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}  # one dense group
    compared, real = [], simhash.written

    def counting(df, name):
        out = real(df, name)
        if name == "parts" and "full" in out.columns:
            open_ = out.where("not full")
            u = open_.where("part != largest").groupBy("key").agg(F.count("*").alias("u"))
            compared.append(u.join(open_.groupBy("key").agg(F.count("*").alias("v")), "key").agg(F.sum(F.col("u") * F.col("v"))).first()[0] or 0)
        return out

    monkeypatch.setattr(simhash, "written", counting)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = dict(rows(simhash.linked(fps, n)))
    wanted = brute_links(values)
    assert {v: r for v, r in wanted.items() if v != r or r in got.values()} == {**{r: r for r in got.values()}, **got}
    assert sum(compared) < 150_000 and (len(compared) > 1 or n > 10**9), compared


def test_owners_of_a_window_are_looked_up_once_a_text(spark):
    n = 2_000
    bench = spark.createDataFrame([(i, "yes") for i in range(n)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes " * 20_000), (2, "no")], "doc_id long, text string")
    tables = decontamination.compile_patterns([(str(i), "yes") for i in range(n)])
    asked, real = [], decontamination.Patterns.owners
    decontamination.Patterns.owners = lambda self, p: asked.append(len(p)) or real(self, p)
    try:
        _, spans, items = decontamination.search(quality.pa.array(["yes " * 20_000], quality.pa.large_string()), tables)
    finally:
        decontamination.Patterns.owners = real
    assert asked == [1] and len(items[0]) == n and spans == [[(0, 20_000)]]
    found = {r["doc_id"]: (r["n_words"], len(r["items"])) for r in decontamination.find_passages(docs, bench).collect()}
    assert found == {1: (20_000, n), 2: (1, 0)}


def test_a_long_item_is_cut_without_losing_windows(spark):
    draw = random.Random(6)
    words = [f"w{draw.randrange(10**6)}" for _ in range(3_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short item"), (3, None), (4, "é!" + " ü" * 3)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before " + " ".join(words[i * 100 + 3 : i * 100 + 3 + n]) + " after") for i, n in enumerate([10, 9, 12, 200, 300] * 5)] + [(99, "a short item and é ü ü ü")], "doc_id long, text string")
    whole = rows(decontamination.find_passages(docs, bench))
    assert sum(bool(r[3]) for r in whole) == 21
    pieces = list(decontamination.pieces_of(quality.pa.array([" ".join(words)]), 10, 500))
    assert len(pieces) > 40 and max(len(p) for _, p in pieces) < 600
    for size in (2_000, 20_000):
        assert rows(decontamination.find_passages(docs, bench, block_bytes=size)) == whole


def test_scores_of_rows_that_repeat_id_and_text(spark, monkeypatch):
    """Many equal rows are counted and scored as one; the rows are those of the plain way."""
    draw = random.Random(9)
    texts = [" ".join(f"w{draw.randrange(40)}" for _ in range(draw.randrange(30))) for _ in range(60)]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "the same text")] * 40 + [(3, texts[3])] * 30 + [(4, None)] * 25 + [(12, "tuned the same")] * 30
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    plain = lm_scoring.score(docs)
    wanted = sorted(((r["doc_id"], r["part"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 6)) for r in plain.collect()), key=repr)
    monkeypatch.setattr(lm_scoring, "REPEATS", 10)
    monkeypatch.setattr(lm_scoring, "MOST_REPEATED", 100)
    dealt, *_, repeated = lm_scoring.grouped(docs)
    assert repeated is not None and dealt.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] == 1
    got = sorted(((r["doc_id"], r["part"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 6)) for r in lm_scoring.score(docs).collect()), key=repr)
    assert got == wanted and len(got) == len(data)
