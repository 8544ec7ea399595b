import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import runs


def brute(w, least, times):
    """Every stretch of period q by a plain walk, for each q; those whose smallest period is q."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                part = w[i : i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        w, size = [], r.randint(0, 160)
        while len(w) < size:
            if r.random() < 0.3:
                unit = [r.choice("abc") for _ in range(r.randint(1, 20))]
                w += (unit * 12)[: r.randint(1, 6 * len(unit))]
            else:
                w.append(r.choice("abcd"))
        yield w
    yield ["a"] * 500
    yield (["a", "b"] * 60) + (["b"] * 30) + (["a", "b", "b"] * 9)


@pytest.mark.parametrize("least,times", [(24, 3), (8, 3), (5, 2), (1, 4)])
@pytest.mark.parametrize("points", [50, 4_000_000])
def test_runs_match_brute_force(monkeypatch, least, times, points):
    monkeypatch.setattr(runs, "POINTS", points)
    held = list(texts(least, 150))
    counts = np.array([len(w) for w in held], np.int64)
    codes = np.array([ord(c) for w in held for c in w], np.int64)
    found = runs.find_runs(counts, codes, least, times)
    want = [(t, *r) for t, w in enumerate(held) for r in brute(w, least, times)]
    assert [tuple(r) for r in found.tolist()] == want and len(want) > 40


def test_minima_and_extensions():
    r = np.random.default_rng(4)
    values = r.integers(0, 50, 3_000).astype(np.int32)
    low, high = np.sort(r.integers(0, 3_000, (2, 5_000)), axis=0)
    assert (runs.Minima(values)(low, high) == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]).all()
    codes, owner = r.integers(0, 2, 600), np.repeat([0, 1, 2], 200)
    reach = runs.Extensions(owner, codes)
    for i, j in r.integers(0, 200, (300, 2)):
        if i != j:
            k = 0
            while max(i, j) + k < 200 and codes[i + k] == codes[j + k]:
                k += 1
            assert reach(np.array([i]), np.array([j]))[0] == k


def test_a_long_periodic_text_stays_cheap():
    import time

    codes = np.tile(np.arange(7), 40_000)
    began = time.perf_counter()
    assert runs.find_runs(np.array([len(codes)]), codes).tolist() == [[0, 0, len(codes), 7]]
    assert time.perf_counter() - began < 60


def brute_op11(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        found = brute(w, 24, 3)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        line = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        rest = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(found), *four, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_matches_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["a", "b", "Ünï", "x|"]) for _ in range(r.choice([0, 1, 5, 30, 90])))) for i in range(120)]
    rows += [(n, " \t".join(w) + "\n") for n, w in zip(range(500, 560), texts(7, 58), strict=True)]
    rows += [(None, "a " * 40), (None, None), (900, None), (901, ""), (902, " \n\t "), (903, "a\x00 " * 30), (904, "x " * 30), (904, "x " * 30)]
    docs = spark.createDataFrame([(i, t, "t") for i, t in rows], "doc_id long, text string, _n string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = runs.op11_periodic_runs(spark, str(tmp_path))
    want = brute_op11(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == want and sum(w[1] > 0 for w in want) > 40
    assert runs.op11_periodic_runs(spark, str(tmp_path)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = runs.op11_periodic_runs(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in docs.where(F.length("text") < 9_000).select("doc_id", "text").collect()]
    ids = {i for i, _ in rows}
    assert sorted((tuple(r) for r in found.collect() if r.doc_id in ids), key=repr) == brute_op11(rows)


def test_edges(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    found = runs.periodic_runs(spark.createDataFrame([(1, "go " * 30 + "on", "x")], "doc_id long, text string, runs string")).first()
    assert (found.n_words, found.collapsed, [tuple(r) for r in found.runs]) == (31, "go on", [(0, 30, 1)])
