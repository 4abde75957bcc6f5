"""The operators' queries against SQL or brute force on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from oracle import canonical, connect

from shardloom.llm import catalog

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def found(spark, name, data=DATA):
    return catalog.QUERIES[name](spark, data).toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    assert canonical(catalog.QUERIES[name](spark, DATA).toPandas()) == canonical(con.sql(catalog.SQL[name]).df())


def simhash(text):
    import xxhash

    w = SPACED.findall(text.translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4):
            a, b = find(k), find(keys[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash(spark, texts):
    got, prints = found(spark, "op4_simhash"), {k: simhash(t) for k, t in texts.items()}
    assert dict(got.fingerprint) == {k: f"{v:016x}" for k, v in prints.items()}
    assert dict(got.component_id) == linked(prints)


def test_token_files(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    got, start = found(spark, "op5_token_files"), 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[k], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got.loc[k]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def test_pii(spark, texts):
    got = found(spark, "op7_pii")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    for k, text in texts.items():
        spans = sorted((m.start(), i, kind, m.end()) for i, (kind, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m))
        base = [f"{kind}:{a}:{b}" for a, _, kind, b in spans]
        assert got.base_sha256[k] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[f"n_{kind}"][k] for kind in kinds] == [sum(x[2] == kind for x in spans) for kind in kinds]
        assert set(base) <= set(got.spans[k].split(",")) | {""}


def test_licenses(spark, texts):
    got = found(spark, "op3_licenses")
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for k, text in texts.items():
        w = ALNUM.findall(text.translate(LOWER))
        places = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got.loc[k]
        labels = sorted({x for _, x in places})
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == (min(places)[0], max(places)[0]) if places else r.first_word != r.first_word
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_lm_base_and_gain(spark, texts):
    got, counts = found(spark, "op6_lm_scoring"), Counter()
    words = {k: [*SPACED.findall(t.translate(LOWER)), "\n"] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    for k, w in words.items():
        if not held[k]:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for k, w in words.items():
        r = got.loc[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, con, name, label, least):
    got = found(spark, name, "/root/testdata/sf0.01")
    labels = dict(con.sql(f"SELECT doc_id, {label} FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    out = got[got.held_out & got.index.isin(labels)]
    assert (out.predicted == [labels[k] for k in out.index]).mean() >= least
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
