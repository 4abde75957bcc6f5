"""Conversation repair against a plain search, for every size of blocks."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import conversations as C

BLANK = " \t\n\x0b\f\r"


def cheapest(codes):
    """(cost, audit) by trying every edit in every state, at most two inserts in a row."""

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(codes) and state in (0, 3) else []
        if inserts < 2:
            cost, audit = best(i, (2, 2, 3, 2)[state], inserts + 1)
            found.append((cost + 3, "I" + audit))
        if i < len(codes):
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit))
            if codes[i] != C.FORCED:
                more = 3 * (codes[i] & 1)
                cost, audit = best(i + 1, (2, 2, 3, 2)[state], 0)
                found.append((cost + 3 + more, "R" + audit))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get(("sua?"[codes[i] >> 1], state))
                if to:
                    cost, audit = best(i + 1, to, 0)
                    found.append((cost + more, "K" + audit))
        return min(found) if found else (10**9, "")

    return best(0, 0, 0)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=40))
def test_walk_is_the_least_of_the_cheapest(codes):
    state, audit = 0, ""
    for edits in C.walked(codes, C.END, (0,))[0]:
        audit += edits
    cost, want = cheapest(codes)
    vector = C.END
    for code in reversed(codes):
        vector = C.before(code, vector)
    assert vector[state] == cost
    assert want.startswith(audit) and set(want[len(audit) :]) <= {"I"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=12), st.lists(st.integers(0, 8), max_size=12))
def test_costs_between_states_compose(a, b):
    costs, after = C.between(a), C.END
    for code in reversed(b):
        after = C.before(code, after)
    whole = after
    for code in reversed(a):
        whole = C.before(code, whole)
    assert whole == tuple(min(costs[4 * s + e] + after[e] for e in range(4)) for s in range(4))


def plain(table):
    """The contract's result, row by row; without the order of rows of one turn that differ."""
    out = {}
    for conv in {r[0] for r in table}:
        kept = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, codes, counts = set(), [], [0] * 4
        for _, role, text in kept:
            bare = text.strip(BLANK)
            fault = 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3
            seen.add((role, text))
            counts[fault] += 1
            codes.append(C.code_of(role, fault))
        cost, audit = cheapest(codes)
        state, i, lines = 0, 0, []
        for x in audit:
            role, text = kept[i][1:] if x in "KR" else ("", "")
            state = {"D": state, "I": (2, 2, 3, 2)[state], "R": (2, 2, 3, 2)[state]}.get(x) if x != "K" else {"s": 1, "u": 2, "a": 3}[role[0]]
            if x in "KIR":
                lines.append(f"{role if x == 'K' else 'user' if state == 2 else 'assistant'}:{text}")
            i += x != "I"
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def table():
    draw = random.Random(5)
    texts = ["Yes.", "No", "Well!", "", " \n", None, "A long answer that ends", "Why?", "é ü.", "漢字"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    out = [(draw.choice([1, 2, 3, 4, None]), draw.choice([*range(30), None]), draw.choice(roles), draw.choice(texts)) for _ in range(250)]
    out += [(9, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(300)]  # most rows of all
    out += [(10, 5, "user", "Same.")] * 40 + [(11, i, "user", "Same.") for i in range(40)]
    return out + [(c, 0, "user", "Alone.") for c in range(20, 60)]


@pytest.mark.parametrize("block_rows", [1, 3, 50, None])
def test_equals_plain_search(spark, table, block_rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, digest string, n int")
    got = C.repaired(C.damaged(df.repartition(5)), block_rows)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(table)


def test_long_text_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    long = "word " * 200_000 + "."
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "Yes.")], schema)
    assert {r[0]: tuple(r)[1:] for r in C.repaired(C.damaged(df)).collect()} == plain([tuple(r) for r in df.collect()])
    assert rows(C.repaired(C.damaged(df.where("false")))) == []
