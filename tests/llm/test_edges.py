"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; parts of the methods on their own."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import canonical
from pyspark.sql import functions as F

from shardloom.llm import common, components, decontamination, exact_dedup, licenses, lm_scoring, mixing, pii, quality, simhash, token_files, toxicity, wide_simhash, words

SCHEMA = "doc_id long, text string, source string, n_chars long, digest string, copies string, rate string, fp string, spans string"
LONG = "word " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows; the last columns clash with names that the operators use inside."""
    data = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, "one two", "b"), (4, "one two", "b"), (None, "nobody", None), (5, "ONE\ttwo", "b"), (6, "é ü 漢字 \x00x", "a"), (7, "   \n", "c")]
    return spark.createDataFrame([(*r, 0, "x", "x", "x", "x", "x") for r in data], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "!?")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, None, None), (None, 1, 1), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")


def test_exact_dedup(spark, odd, empty):
    got = sorted(rows(exact_dedup.mark_duplicates(odd).select("doc_id", "keep_id", "group_size", "kept")), key=repr)
    assert (1, 7, 3, False) in got and (2, 7, 3, False) in got and (7, 7, 3, True) in got  # empty after blanks go; the longest stays
    assert got.count((4, 4, 2, True)) == got.count((4, 4, 2, False)) == 1 and (5, 5, 1, True) in got
    assert (None, None, 1, True) in got
    assert exact_dedup.mark_duplicates(empty).count() == 0


def test_digest_index_takes_batches(spark):
    batch = lambda *r: exact_dedup.digests(spark.createDataFrame(list(r), "doc_id long, text string"))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(batch((1, "a"), (2, "a ")))
    index.add(batch((3, "a"), (4, "b")))
    index.add(batch((3, "a"), (4, "b")))
    assert sorted(r["keep_id"] for r in index.rows().collect()) == [2, 4]
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert again.rows().count() == 2


def test_compacted_index(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    for i in range(3):
        index.add(exact_dedup.digests(spark.createDataFrame([(10 * i + j, f"text {i * j}") for j in range(8)], "doc_id long, text string")))
    new = index.compacted()
    files = lambda x: x.rows().select(F.input_file_name()).distinct().count()
    assert files(new) == 2 < files(index)
    assert rows(new.rows()) == rows(index.rows())
    new.add(exact_dedup.digests(spark.createDataFrame([(99, "text 0"), (98, "new")], "doc_id long, text string")))
    assert new.rows().count() == index.rows().count() + 1


def test_mixing(spark, odd, empty):
    plan = {(r["doc_id"], r["size"]): r for r in mixing.plan(odd).collect()}
    assert plan[(3, 40_000)]["size"] == 40_000 and plan[(1, 0)]["source_size"] == 40_003
    assert mixing.plan(empty).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(empty).count() == 0
    assert rows(mixing.mixed(odd)) == rows(out)


def brute_targets(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 2000), min_size=1))
@settings(max_examples=8, deadline=None)
def test_targets_equal_resharing(spark, sizes):
    found = {r["source"]: r["target"] for r in mixing.rates(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def test_simhash(spark, odd, empty):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(7, 0)] == 1
    assert simhash.near_duplicates(empty).count() == 0 and wide_simhash.deduplicated(empty).count() == 0
    out = wide_simhash.deduplicated(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "6", "None"]


@pytest.mark.parametrize("n", [100, 3_000_000, 10**9, 10**10])
def test_all_components_for_any_block_count(spark, n):
    random = np.random.default_rng(3)
    base = random.integers(-(2**62), 2**62, 60)
    near = [int(b) ^ sum(1 << int(i) for i in random.choice(63, k, False)) for b in base for k in (1, 3, 4, 5)]
    values = sorted({*map(int, base), *near})
    got = dict(rows(simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"), n)))
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    nodes, roots = components.local_roots(*np.array(links).T)
    wanted = {int(a): int(b) for a, b in zip(nodes, roots, strict=True)}
    assert {a: got.get(a, a) for a in wanted} == wanted and set(got) <= set(wanted) and len(links) >= 180


def test_dense_group_writes_no_square(spark, monkeypatch):
    """1,954 fingerprints within two bits of one, and a chain of groups four bits apart."""
    near = lambda x: [x, *(x ^ (1 << i) for i in range(62)), *(x ^ (1 << i) ^ (1 << j) for i in range(62) for j in range(i))]
    values = sorted({*near(0x0123456789ABCDEF), *(0x7EDCBA9876543210 >> 1 ^ (1 << 4 * k) - 1 for k in range(12))})
    sizes = []
    real = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: sizes.append((name, (out := real(df, name)).count())) or out)
    got = dict(rows(simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"), len(values))))
    array = np.array(values, np.uint64)
    links = [(a, int(b)) for i, a in enumerate(values) for b in array[i + 1 :][np.bitwise_count(array[i + 1 :] ^ array[i]) <= 4]]
    nodes, roots = components.local_roots(*np.array(links).T)
    assert {int(a): got.get(int(a), int(a)) for a in nodes} == {int(a): int(b) for a, b in zip(nodes, roots, strict=True)}
    assert len(links) > 1_000_000 and max(n for name, n in sizes if name == "links") < 15 * len(values)  # at most one a choice of blocks


def test_largest_part_is_not_paired_with_itself(spark):
    """Bucket 1: a part of 50, one of 3 and a stranger; bucket 2: a part and nothing else; bucket 3: two parts of one size."""
    members = [(1, 7, n) for n in range(50)] + [(1, 8, n) for n in range(50, 53)] + [(1, 9, 53)] + [(2, 7, n) for n in range(9)] + [(3, 4, 1), (3, 5, 2)]
    rest, every = components.between_parts(spark.createDataFrame(members, "key long, part long, node long"), ["key"])
    assert sorted(r["node"] for r in rest.where("key = 1").collect()) == [50, 51, 52, 53]
    assert [(r["key"], r["node"]) for r in rest.where("key <> 1").collect()] == [(3, 1)]
    assert every.groupBy("key").count().orderBy("key").collect() == [(1, 54), (3, 2)]



@pytest.mark.parametrize("per_task", [1000, 20])
def test_components(spark, per_task):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 105), (-5, 200)] + [(300, i) for i in range(301, 330)]
    found = rows(components.components(spark.createDataFrame(chain, "u long, v long"), per_task))
    wanted = [(i, 0) for i in range(1, 61)] + [(101, 100), (105, 100), (200, -5)] + [(i, 300) for i in range(301, 330)]
    assert found == sorted(wanted, key=repr)


def test_decontamination(spark, odd, empty, bench):
    got = {r["doc_id"]: (r["n_words"], len(r["items"])) for r in decontamination.find_passages(odd, bench).collect()}
    assert got[1] == (0, 0) and got[3] == (40_000, 0) and got[4] == (2, 1) and got[5] == (2, 1) and got[7] == (0, 0)
    assert decontamination.find_passages(empty, bench).count() == 0
    assert decontamination.find_passages(odd, bench.where("false")).count() == 9
    out = decontamination.clean(odd, bench)
    assert out.columns == odd.columns and out.count() == 6


def test_benchmark_in_blocks_gives_the_same(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = decontamination.find_passages(*t)
    assert whole.where("size(items) > 0").count() > 0
    assert rows(decontamination.find_passages(*t, block_bytes=2000)) == rows(whole)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=4), st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=4))
@settings(max_examples=150, deadline=None)
def test_search_equals_brute_force(texts, items):
    width = 3
    tables = decontamination.compile_patterns([(str(i), " ".join(x)) for i, x in enumerate(items)], width)
    _, spans, found = decontamination.search(pa.array([" ".join(t) for t in texts], pa.large_string()), tables)
    for t, s, f in zip(texts, spans, found, strict=True):
        hit, wanted = set(), set()
        for i, x in enumerate(items):
            for at in range(max(len(x) - width + 1, bool(x))):
                p = x[at : at + width]
                for j in range(len(t) - len(p) + 1):
                    if t[j : j + len(p)] == p:
                        hit |= set(range(j, j + len(p)))
                        wanted.add(str(i))
        assert {j for a, b in decontamination.united(s) for j in range(a, b)} == hit and f == wanted


def test_hits_are_counted_once(spark):
    docs = spark.createDataFrame([(1, "a b c a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "b c a"), (3, "b")], "item_id long, text string")
    found = decontamination.find_passages(docs, items).select("n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])).first()
    assert tuple(found) == (5, 5)


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 24])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    for a, b in ((0, 1001), (5, 6), (13, 900), (1000, 1001), (4, 4)):
        assert (token_files.unpack(data, width, a, b) == ids[a:b]).all()


TEXT = st.text(st.sampled_from(" \n\t\r\x0bab'éñ漢1.!s  \x85\x1c"), max_size=40)


@given(st.lists(TEXT, min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(texts):
    coder = token_files.encoder(token_files.tokenizer_path())
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_with_a_full_table():
    coder = token_files.Encoder(token_files.tokenizer_path(), limit=30)
    texts = [" ".join(f"w{i}x{j}" for i in range(25)) + "\nline two, end." for j in range(5)]
    for text in texts * 2:
        assert coder.encode([text, "a"])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    many = " ".join(f"v{i}" for i in range(3000))  # more pieces than the table's limit in one batch
    assert token_files.Encoder(token_files.tokenizer_path(), limit=300).encode([many])[0].tolist() == coder.whole(many)


def test_token_files(spark, odd, empty):
    got = token_files.token_output(odd).orderBy(F.col("start")).collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    assert [r["start"] for r in got[1:]] == list(np.cumsum([r["n_tokens"] for r in got])[:-1])
    assert got[1]["n_tokens"] == 1 and token_files.token_output(empty).count() == 0


def test_pii(spark, odd, empty):
    text = "@b.c@d.e a@b.c@d.e 1.2.3.256 10.0.0.1 +1 (555) 123-4567 or 4111 1111 1111 1111 iban DE89 3704 0044 0532 0130 00 x ssn 123-45-6789 " + "9" * 5000 + " +" + "1" * 3000
    kinds = [text[a:b] for a, b, k, _ in pii.spans_of(text)]
    assert kinds == ["b.c@d.e", "a@b.c", "10.0.0.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "123-45-6789"]
    assert pii.masked("mail a@b.de now") == "mail <email> now"
    assert pii.find_pii(odd).count() == 9 and pii.find_pii(empty).count() == 0


def test_licenses(spark, odd, empty):
    texts = ["Under the MIT License; under the mit license", "under the mit", "(CC-BY-NC)", "Permission is hereby granted, free of charge, to any person obtaining a copy ... without restriction", "permission is hereby granted free of charge to any person obtaining a copy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: sorted((p["label"], p["place"], p["base"]) for p in r["places"]) for r in licenses.scan(docs).collect()}
    assert got == {0: [("mit", 0, True), ("mit", 4, True)], 1: [], 2: [("cc-by-nc", 0, True)], 3: [("mit", 0, False)], 4: []}
    assert licenses.scan(odd).count() == 9 and licenses.scan(empty).count() == 0


def test_licenses_of_awkward_rows_equal_sql(spark, odd, empty, tmp_path):
    texts = ["Under the MIT License; under the mit license", "cc by nc sa cc by nc", "spdx-license-identifier: apache-2.0", "Copyright 2020 X. All rights reserved", "all rights reserved", None]
    texts += [" ".join(t.words) for t in licenses.TEMPLATES] + [" ".join(t.words[len(t.words) // 3 :]) for t in licenses.TEMPLATES] + [" x y ".join([t.text, t.text]) for t in licenses.TEMPLATES]
    more = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, docs in (("some", odd.unionByName(more, allowMissingColumns=True)), ("none", empty)):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        got, wanted = licenses.op3_licenses(spark, f"file://{tmp_path}/{name}").toPandas(), con.sql(licenses.SQL).df()
        assert canonical(got) == canonical(wanted)
    assert len(got) == 0


def test_lm(spark, odd, empty):
    got = {r["doc_id"]: r for r in lm_scoring.score(odd).collect()}
    assert got[1]["n_tokens"] == 1 and got[3]["n_tokens"] == 40_001 and all(np.isfinite([r["score"] for r in got.values()]))
    assert lm_scoring.score(empty).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(200)], "doc_id long, text string").where(common.fold(7) == 2)
    found = lm_scoring.score(only_held).first()
    assert (found["train_tokens"], found["n_known"]) == (0, 0) and np.isfinite(found["score"])


def test_lm_probabilities_sum_to_one(spark):
    """Over the whole vocabulary and one unknown word, after a context."""
    data = [(i, "a b a c") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    shown = {r["part"] for r in lm_scoring.score(docs).collect()}
    assert shown == {0, 1, 2}
    weights = lm_scoring.fit_weights([(3, int(lm_scoring.binned(np.array([0.5]))[0]), int(lm_scoring.binned(np.array([0.25]))[0]), 10.0)], 0.1)
    assert np.allclose(weights.sum(1), 1) and weights[3, 0] > 0.9


def test_lm_groups_and_ranges_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    for r in lm_scoring.score(docs, 40_000, 60_000).collect():
        assert (r["n_known"], r["train_tokens"]) == (one[r["doc_id"]]["n_known"], one[r["doc_id"]]["train_tokens"])
        assert r["score"] == pytest.approx(one[r["doc_id"]]["score"], rel=1e-9)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True), st.lists(st.integers(0, 2**40), max_size=50))
@settings(deadline=None)
def test_packed_numbers(hashes, counts):
    h = np.array(sorted(hashes), np.uint64)
    assert (lm_scoring.unpacked_hashes(lm_scoring.packed_hashes(h)) == h).all()
    c = np.array(counts, np.int64)
    assert (lm_scoring.unpacked(lm_scoring.packed(c)) == c).all()


def test_quality(spark, odd, empty, labels):
    model = quality.fitted(odd, labels)
    assert quality.scored(odd, model).count() == 9 and quality.scored(empty, model).count() == 0
    assert quality.accepted(odd, model).columns == odd.columns
    none = quality.fitted(odd, labels.where("false"))
    assert {r["score"] for r in quality.scored(odd, none).collect()} == {0.5}
    assert quality.fitted(empty, labels).bias == 0.0


def test_quality_learns():
    good, bad = ["the quiet river runs past the old mill"] * 30, ["BUY!! NOW!! CHEAP!!"] * 10
    model = quality.train(good + bad, [1] * 30 + [0] * 10)
    high, low = model.scores(pa.array(["the old river runs", "CHEAP!! BUY!!"], pa.large_string()))
    assert high > 0.5 > low


def test_sample_is_bounded(spark, odd):
    labels = odd.select("doc_id").where("doc_id is not null").withColumn("quality", F.lit(1))
    texts, _ = quality.sample(odd, labels, "quality", F.lit(True), rows=3)
    assert len(texts) <= 4
    assert sum(map(len, quality.sample(odd, labels, "quality", F.lit(True), most_bytes=1000)[0])) <= 1000


def test_toxicity(spark, odd, empty, labels):
    lexicon = toxicity.learn([], [])
    assert lexicon.score("you idiot") > 0.5 > lexicon.score("you friend")
    for text in ("1d10t here", "і​diot", "ｉｄｉｏｔ", "IDIOT!!", "(idiot)"):
        assert lexicon.score(text) > 0.5, text
    for text in ("idiotic", "trash can", "clown fish", "the pathetic fallacy", "", "2024 10.0.0.1"):
        assert lexicon.score(text) < 0.5, text
    assert toxicity.scored(odd, lexicon).count() == 9 and toxicity.scored(empty, lexicon).count() == 0
    fitted = toxicity.learn(*quality.sample(odd, labels, "toxic", F.lit(True)))
    assert fitted.weights


def test_words_of_rows():
    texts = ["", "A b", "c", "", "é,d\x00e f", "  "]
    w = words.words_of(pa.array(texts, pa.large_string()), words.SPACED)
    assert w.counts().tolist() == [0, 2, 1, 0, 2, 0]
    again = words.words_of(pa.array(["a", "B c"], pa.large_string()), words.SPACED)
    assert w.key[:3].tolist() == again.key.tolist()
    assert len(set(words.words_of(pa.array([f"w{i}" for i in range(5000)], pa.large_string()), words.ALNUM).key.tolist())) == 5000


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = words.words_of(pa.array(["a", text, "b c"], pa.large_string()), words.SPACED)
    model = quality.train(["good day"] * 5 + ["bad bad"] * 5, [1] * 5 + [0] * 5)
    score = model.scores(pa.array([text], pa.large_string()))[0]
    monkeypatch.setattr(words, "HASHED_BYTES", 50)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert (words.words_of(pa.array(["a", text, "b c"], pa.large_string()), words.SPACED).key == whole.key).all()
    assert abs(model.scores(pa.array([text], pa.large_string()))[0] - score) < 0.02


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        assert name == "mixing" or {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_clean_in_blocks(spark):
    docs, bench = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    hit = {r["doc_id"] for r in decontamination.find_passages(docs, bench).where("size(spans) > 0").collect()}
    kept = {r["doc_id"] for r in decontamination.clean(docs, bench, block_bytes=3000).collect()}
    assert hit and not hit & kept and len(hit) + len(kept) == docs.count()


def brute_licenses(text):
    """(label, place) of the method's own templates, each start tried: two indexed words agree and all key phrases stand near."""
    w, found = [x for x in licenses.cut(text or "")], set()
    for t in licenses.TEMPLATES:
        offsets = {}
        for i, x in enumerate(t.words):
            offsets.setdefault(x, []).append(i)
        starts = {}
        for i, x in enumerate(w):
            for o in offsets.get(x, ()):
                starts.setdefault(i - o, set()).add(x)
        slack = 0 if t.base else licenses.SLACK
        for start in (s for s, words in starts.items() if len(words) > 1 and (s >= 0 or not t.base)):
            stands = [[max(0, p - at) for at, k in key for p in range(max(0, start + at - slack), max(0, start + at + slack) + 1) if w[p : p + len(k)] == k] for key in t.phrases()]
            if all(stands):
                found.add((t.label, stands[0][0]))
    return found


def test_license_labels_equal_brute_force(spark):
    """Whole licence texts have all labels that brute force finds; of changed and cut ones a label may go where only words agree that aren't among a file's top ones."""
    own = [t.text for t in licenses.TEMPLATES if not t.base]
    filler = " ".join(f"filler{i}" for i in range(50))
    texts = [*own, *(f"{filler} {t} {filler}" for t in own), *(t.replace("software", "program") for t in own), f"{own[0]} {own[1]}", *(t[: len(t) // 2] for t in own), filler, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {(p["label"], p["place"]) for p in r["places"]} for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        wanted = brute_licenses(text)
        assert got[i] <= wanted, (text, got[i], wanted)
        assert i >= 2 * len(own) or {x for x, _ in got[i]} == {x for x, _ in wanted}, (text, got[i], wanted)
    changed = {i - 2 * len(own) for i in range(2 * len(own), 3 * len(own)) if brute_licenses(texts[i]) and not got[i]}
    assert len(changed) <= 1


def changed_licenses(share, copies, seed=5):
    """(label, text): the long templates, with about this share of their words replaced."""
    random = np.random.default_rng(seed)
    long = [t for t in licenses.TEMPLATES if not t.base and len(t.words) > 10]
    return [(t.label, " ".join(f"changed{i}" if random.random() < share else w for i, w in enumerate(t.words))) for t in long for _ in range(copies)]


def license_recall(spark, share, copies):
    """The found part of changed licences by label, and the labels of 500 other texts."""
    texts = changed_licenses(share, copies)
    other = [(None, r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(500).collect()]
    docs = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts + other)], "doc_id long, text string")
    got = {r["doc_id"]: {p["label"] for p in r["places"]} for r in licenses.scan(docs).collect()}
    by_label = {}
    for i, (label, _) in enumerate(texts):
        by_label.setdefault(label, []).append(label in got[i])
    return {k: sum(v) / len(v) for k, v in by_label.items()}


@pytest.mark.parametrize("share, least, on_average", [(0.05, 0.8, 0.95), (0.1, 0.65, 0.9)])
def test_changed_licenses_are_found(spark, share, least, on_average):
    got = license_recall(spark, share, 40)
    assert len(got) == 9 and min(got.values()) >= least and sum(got.values()) / len(got) >= on_average, got


def test_license_of_a_long_text(spark):
    text = "copy person license " * 20_000 + "under the mit license " + "spdx license " * 5000
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["places"]
    assert [(p["label"], p["place"]) for p in got if p["base"]] == [("mit", 60_000)]
