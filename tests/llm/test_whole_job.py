"""Rows, texts and sessions for which an operator once did less than the whole job."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import decontamination, exact_dedup, lm_scoring, mixing, pii, quality, token_files, toxicity, wide_simhash


def test_one_row_of_each_group_whatever_its_ids(spark):
    a, b, c, d = ("".join(f" {x}{i}" for i in range(40)) for x in "abcd")
    data = [(None, a), (None, b), (7, c), (7, d), (7, d), (9, d), (7, c + " "), (None, c), (8, a), (8, a)]
    out = wide_simhash.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"].strip()[0]) for r in out) == [("7", "c"), ("7", "d"), ("8", "a"), ("None", "b")]


def test_added_tokens_in_texts():
    coder = token_files.encoder(token_files.tokenizer_path())
    texts = ["one <|endoftext|> two", "one two", "<|endoftext|>", "a\n<|endoftext|><|endoftext|>b  c", "<|endoftext"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.tokenizer_path())
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert coder.encode(texts)[0].tolist() == [505, 220, 50256, 734]


def test_added_tokens_in_files(spark):
    docs = spark.createDataFrame([(1, "one <|endoftext|> two"), (2, "x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in token_files.token_output(docs).collect()}
    assert got == {1: (0, 5), 2: (5, got[2][1])}


@pytest.mark.parametrize("buckets", [None, 4, 8])
def test_index_keeps_its_rows_when_the_catalog_forgets_it(spark, buckets):
    batch = lambda *r: exact_dedup.digests(spark.createDataFrame(list(r), "doc_id long, text string"))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(batch((1, "a"), (2, "b")))
    index.forget()
    again = exact_dedup.DigestIndex(spark, index.path, buckets)
    again.add(batch((3, "a"), (4, "c"), (5, "b ")))
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [1, 2, 4]
    assert sorted(r["keep_id"] for r in spark.table(again.name).collect()) == [1, 2, 4]
    again.forget()
    marks = exact_dedup.mark_duplicates(spark.createDataFrame([(6, "a"), (7, "d")], "doc_id long, text string"), exact_dedup.DigestIndex(spark, index.path))
    assert sorted((r["doc_id"], r["kept"]) for r in marks.collect()) == [(6, False), (7, True)]


def ibans(text):
    return [text[a:b] for a, b, kind, _ in pii.spans_of(text) if kind == "iban"]


def test_ibans_before_other_words():
    assert ibans("IBAN DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert ibans("IBAN DE89 3704 0044 0532 0130 00 2024") == ["DE89 3704 0044 0532 0130 00"]
    assert ibans("NO93 8601 1117 947 AND GB82 WEST 1234 5698 7654 32 OR ELSE") == ["NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32"]
    assert ibans("AB12 3456 DE89 3704 0044 0532 0130 00") == ["DE89 3704 0044 0532 0130 00"]  # begins inside a failed one
    assert ibans("DE89370400440532013001 BIC") == ibans("DE89370400440532013000X") == ibans("xDE89370400440532013000") == []
    assert pii.masked("IBAN DE89370400440532013000 BIC COBADEFFXXX") == "IBAN <iban> BIC COBADEFFXXX"


def test_iban_of_a_country_without_a_known_length():
    body = "ZZ00ABCD123456789012"
    check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
    text = f"ZZ{check:02d}ABCD123456789012"
    assert ibans(f"iban {text} x") == [text] and ibans(f"iban {text} Z") in ([text], [f"{text} Z"])


def test_iban_scan_is_linear():
    assert ibans("AA11 " * 40_000) == [] and np.isfinite(len(ibans("DE89 3704 " * 20_000)))


def test_one_document_of_the_files(spark):
    data = [(i % 7 or None, f"text number {i} " * (i + 1)) for i in range(20)]
    path = token_files.scratch(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame(data, "doc_id long, text string"), path, block_ids=40)
    coder = token_files.encoder(token_files.tokenizer_path())
    for doc_id in (3, None, 99):
        wanted = sorted([*coder.whole(t), token_files.END_ID] for d, t in data if d == doc_id)
        assert sorted(x.tolist() for x in token_files.read_document(spark, path, doc_id)) == wanted
    with pytest.raises(ValueError, match="more than 4 bits"):
        token_files.pack(np.array([3, 16], np.uint32), 4)


def test_pieces_with_one_key():
    coder = token_files.Encoder(token_files.tokenizer_path())
    texts = ["alpha beta gamma", "delta beta"]
    coder.encode(texts)
    coder.table.values[coder.table.keys != 0] = 0  # every key leads to the first piece
    assert [x.tolist() for x in coder.encode(texts)] == [coder.whole(t) for t in texts]


def test_sample_in_hash_order_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 20, f"{i % 20} " * (1 + i % 5 * 40)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    texts, marks = quality.sample(docs, labels, "quality", F.lit(True), most_bytes=2000)
    assert sum(map(len, texts)) <= 2000 and len(texts) == len({t.split()[0] for t in texts}) and {len(t) > 200 for t in texts} == {True, False}
    assert all(int(t.split()[0]) % 2 == y for t, y in zip(texts, marks, strict=True))


@pytest.mark.parametrize("name", ["row", "rate", "own_id", "id", "hash", "rows", "own_hash", "__rate", "__copy", "__source", "__kept", "__rows"])
def test_clashing_names_pass_through(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f", "s", 5), (2, "a b c d e f", "s", 6), (3, "x y", None, 7)], f"doc_id long, text string, source string, {name} long")
    assert sorted(r[name] for r in wide_simhash.one_row_each(docs, spark.createDataFrame([(1, False, 1, docs.select(F.xxhash64("text")).first()[0], 1)], "root long, none boolean, id long, hash long, rows long")).collect()) == [5]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r[name] for r in out.collect()} <= {5, 6, 7}


def test_long_toxic_text_takes_linear_time():
    import time

    lexicon, took = toxicity.learn([], []), []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        assert lexicon.matches("trash can idiot " * n).keys() == set(range(10, 16 * n, 16))
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0]


def test_pii_context_and_case():
    spans = lambda t: {k: s for _, _, k, s in pii.spans_of(t)}
    assert spans("de89 3704 0044 0532 0130 00 is the account") == {"iban": 1.0}
    assert spans("order DE89 3704 0044 0532 0130 00") == {} and spans("x DE89 3704 0044 0532 0130 00")["iban"] == 0.7
    assert spans("123-45-6789 is my social security number")["ssn"] == 0.6 and spans("123-45-6789") == {}
    assert spans("10.0.0.1 login") == {"ip": 0.9} and spans("version 10.0.0.1")["ip"] == 0.3


def test_windows_of_many_items():
    shared = "one two three four five six seven eight nine ten eleven"
    tables = decontamination.compile_patterns([(f"{i:03d}", shared) for i in range(300)] + [("x", "one two"), ("y", "one two")])
    _, spans, items = decontamination.search(pa.array([f"zero {shared} zero", "one two"], pa.large_string()), tables)
    assert [decontamination.united(x) for x in spans] == [[(1, 12)], [(0, 2)]]
    assert items == [{f"{i:03d}" for i in range(300)} | {"x", "y"}, {"x", "y"}]


def test_packed_rows_grow_with_the_input(spark):
    words = [f"w{i}" for i in range(4000)]
    random, found = np.random.default_rng(5), []
    texts = [" ".join(random.choice(words, 60)) for _ in range(3200)]
    for n in (200, 800, 3200):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        dealt, groups, ranges, _ = lm_scoring.grouped(docs, 1, 1)
        found.append((groups, ranges, lm_scoring.counted(dealt, ranges).count()))
    rows_ = [x[2] for x in found]
    assert found[2][0] > found[0][0] > 5 and rows_[1] < 5 * rows_[0] and rows_[2] < 5 * rows_[1]


def test_rows_without_ids_are_spread_over_groups(spark):
    docs = spark.createDataFrame([(None, f"{i:04d} words") for i in range(400)], "doc_id long, text string")
    dealt, groups, *_ = lm_scoring.grouped(docs, 1, 1)
    sizes = [r["count"] for r in dealt.groupBy("grp").count().collect()]
    assert groups > 1 and max(sizes) < 3 * 400 / groups
