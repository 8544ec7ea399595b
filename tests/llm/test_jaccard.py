import random
import re

import numpy as np
import pytest

from quillstone.llm import jaccard

TEXTS = "doc_id long, text string"


def brute(rows, words, percent):
    """Components by comparing every set with every other."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()))
    comp = {i: i for i, _ in sets if i is not None}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    held = [x for x in sets if x[0] is not None and x[1]]
    for k, (i, x) in enumerate(held):
        for j, y in held[:k]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in sets), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [r.choice(vocab) for _ in range(150)]
    other = [r.choice(vocab) for _ in range(40)]
    texts = []
    for k in range(90):  # copies with edits, at most of which are near the limit
        text = list(base)
        for _ in range(k % 6):
            text[r.randrange(150)] = r.choice(vocab) + "x" * (k % 3)
        texts.append(text[r.randrange(0, 8) : 150 - r.randrange(0, 8)])
    for k in range(60):  # copies of copies, which may be near one another only
        text = list(r.choice(texts))
        text[r.randrange(len(text) - 1)] = r.choice(vocab)
        texts.append(text)
    for k in range(80):  # a passage that many texts share
        own = [f"o{k}.{i}" for i in range(r.randrange(1, 60))]
        texts.append(own[:5] + other + own[5:])
    texts += [["a", "b", "c", f"d{k % 7}"] for k in range(30)] + [["q"] * r.randrange(1, 9) for _ in range(20)]
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    rows += [(900 + n, t) for n, t in enumerate((None, "", " \t", "one", "One", "two words", "Two\tWords", "ÀÉ x y", "àé x y", "z " * 3_000))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small,block,share,words,percent", [(5, 4_096, 5, 3, 90), (2, 16, 5, 3, 90), (3, 7, 50, 2, 75), (2, 16, 5, 5, 96)])
def test_components_match_brute_force(spark, monkeypatch, small, block, share, words, percent):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "EARLY", 2**64 // share)
    rows = corpus(words)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, TEXTS), words, percent)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, words, percent)


def test_answers_from_differences_are_those_of_whole_sets():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 60, 400, dtype=np.uint64))
    copy = lambda n: np.unique(np.concatenate([r.permutation(base)[n:], r.integers(0, 1 << 60, n, dtype=np.uint64)]))
    for sets in ([copy(k % 40) for k in range(80)], [np.unique(r.integers(0, 99, 30, dtype=np.uint64)) for _ in range(60)], [base[:1], base[:1], base]):
        for x, near in zip(sets, jaccard.derived_links(sets, sets, 90), strict=True):
            whole = [len(np.intersect1d(x, y)) for y in sets]
            assert near.tolist() == [j for j, n in enumerate(whole) if 100 * n >= 90 * (len(x) + len(sets[j]) - n)]
    assert len(jaccard.similar_set([copy(4) for _ in range(9)])) and not len(jaccard.similar_set([base[:9], base[20:60], base[90:]]))


def test_a_large_group_gives_rows_in_proportion(spark, monkeypatch):
    """Copies of one text with edits of their own, of which hardly any two are linked: no list's pairs come out."""
    r = random.Random(3)
    base = [f"w{r.randrange(10_000)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        text = list(base)
        for j in r.sample(range(4, 116), 1 + i % 3):
            text[j] = f"n{i}x{j}"
        rows.append((i, " ".join(text)))
    seen = []
    plain = jaccard.confirmed
    monkeypatch.setattr(jaccard, "confirmed", lambda pairs, *rest: (seen.append(pairs.count()), plain(pairs, *rest))[1])
    found = jaccard.jaccard_components(spark.createDataFrame(rows, TEXTS), 3, 90)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 3, 90)
    assert sum(seen) < 30 * len(rows)


def test_edges(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], TEXTS)).collect() == []
    rows = [(7, "p q r", "u"), (7, "p q r", "u"), (7, "s t u", "v"), (8, "s t u", "v"), (None, "p q r", "w"), (None, None, "w"), (6, "P q r", "z")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, TEXTS + ", digest string"), 3, 90).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(7, 1, 6), (7, 1, 6), (7, 1, 6), (8, 1, 6), (None, 1, None), (None, 0, None), (6, 1, 6)], key=repr)
