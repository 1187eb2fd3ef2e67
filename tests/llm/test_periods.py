"""Periodic runs against looking at every period of every stretch."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hazelake.llm import periods


def brute(words):
    """{(start, period, length)} by the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            first = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - first + q
            if length >= max(6, 4 * q):
                found.setdefault((first, length), q)
            i = max(i, first) + 1
    return sorted((s, q, length) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def solved(words):
    codes = np.array(periods.coded([w.encode() for w in words], {}), dtype=np.int64)
    p, a, b = periods.fragments(codes, 1, len(codes))
    length = b - a + p
    out = {}
    for q, s, m in zip(p.tolist(), a.tolist(), length.tolist()):
        if m >= max(6, 4 * q):
            out[s, m] = min(q, out.get((s, m), q))
    return sorted((s, q, m) for (s, m), q in out.items())


pieces = st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9))


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=8))
def test_tiles_find_every_run(parts):
    words = list("".join(p * k for p, k in parts))
    assert solved(words) == brute(words)


def test_boundary_values():
    codes = np.array([1, 2, 3, 1, 2, 3, 1, 9])
    back, ahead = periods.boundary_z(codes, np.array([2, 2, 0]), np.array([3, 1, 3]), 4, 6)
    assert back.tolist() == [2, 0, 0] and ahead.tolist() == [2, 0, 4]


def texts_with_runs(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh é naïve x.".split())
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a\x0ba\x0ca\ra\na\ta  a b"]
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 6)):
            unit = [word() for _ in range(rng.randint(1, 40))]
            words += unit * rng.randint(1, 7)
        out.append(" ".join(words))
    return out + [out[9], out[9], "k " * 900]


def expected(doc_id, text, rewrite):
    words = [w.decode() for w in (text or "").encode().split()]
    if rewrite and doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    return doc_id is not None, doc_id, len(words), tuple(runs), collapsed(words, runs)


@pytest.mark.parametrize("long, span, rewrite", [(1 << 20, 1 << 16, None), (1 << 20, 64, periods.looped), (100, 64, periods.looped), (0, 32, None)])
def test_documents_whole_and_dealt_out(spark, long, span, rewrite):
    rows = [(i if i != 11 else None, t, "r", 1, "w") for i, t in enumerate(texts_with_runs(4))]
    rows += [rows[12], rows[12], (10**18, rows[9][1], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, period int, words string").repartition(3)
    found = periods.periodic_runs(docs, rewrite=rewrite, long=long, span=span).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed_sha256"]) for r in found)
    assert got == sorted((a, b or 0, *c) for a, b, *c in (expected(r[0], r[1], rewrite) for r in rows))


def test_summary_of_the_longest_run(spark):
    text = "x x x x x x y a b a b a b a b z k k k k k k k k"
    docs = spark.createDataFrame([(1, text), (2, "no run here"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in periods.summary(periods.periodic_runs(docs)).collect()}
    one = rows[1]
    assert (one["n_runs"], one["start"], one["length"], one["period"], one["exponent_milli"]) == (3, 7, 8, 2, 4000)
    assert one["runs_sha256"] == hashlib.sha256(b"0,6,1\n7,8,2\n16,8,1\n").hexdigest()
    assert one["collapsed_sha256"] == hashlib.sha256(b"x y a b z k").hexdigest()
    assert rows[2]["start"] is None and rows[2]["runs_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["n_runs"] == 0


def test_no_documents(spark, none):
    assert periods.summary(periods.periodic_runs(none)).collect() == []
