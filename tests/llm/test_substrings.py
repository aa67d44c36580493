import hashlib
import re
from collections import Counter

import numpy as np
from gridquarry.llm import substrings as sub
from gridquarry.llm import textkit as tk
from gridquarry.llm.queries import op8_substring_dedup

SF = "/root/testdata/sf0.001"


def brute(docs, length=35):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    seen = Counter(tuple(w[k : k + length]) for _, w in split for k in range(len(w) - length + 1))
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), kept))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op8_substring_dedup(spark, SF).collect()), key=str)
    want = sorted(((a, b, c, hashlib.sha256(k.encode()).hexdigest()) for a, b, c, k in brute(docs)), key=str)
    assert got == want
    assert sum(r[2] for r in got) > 0


def case(spark, docs, **more):
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, start int")
    return sorted((tuple(r) for r in sub.drop_repeated(frame, **more).collect()), key=str)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sub, "PART", 7)
    long = " ".join(f"w{k % 97}-{k // 97}" for k in range(20_000))
    docs = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "x a b c d  y"), (4, "for " * 300), (5, long), (6, long[50_000:90_000]), (7, "q a\tb\nc d z")]
    for length in (4, 9):
        assert case(spark, docs, length=length) == brute(docs, length)
    assert sub.drop_repeated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hot_runs_keep_the_result(spark, monkeypatch):
    monkeypatch.setattr(sub, "HOT_LEAST", 3)
    shared = " ".join(f"s{k}" for k in range(12))
    docs = [(d, " ".join(f"d{d % 17}-{k}" for k in range(20)) + f" {shared} " + " ".join(f"e{d}-{k}" for k in range(20))) for d in range(40)]
    assert case(spark, docs, length=10, buckets=3) == brute(docs, 10)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tk, "run_hashes", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    marked, _ = sub._repeated_windows([b"a b c", b"a b d", b"x a b"], np.array([1, 1, 1]), 2)
    assert marked.tolist() == [True, False, False, True, False, False, False, True, False]
