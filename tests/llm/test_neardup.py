import random
import re

import pytest

from quillstone.llm import neardup

TEXTS = "doc_id long, text string"


def brute(rows, words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    base = [r.choice(vocab) for _ in range(120)]
    for share in [0.0] * 3 + [r.random() * 0.12 for _ in range(60)]:  # a group of near copies, some too far off
        rows.append((n, " ".join(r.choice(vocab) if r.random() < share / 2 else w for w in base)))
        n += 1
    common = " ".join(r.choice(vocab) for _ in range(12))
    for _ in range(25):  # documents that share a passage only
        rows.append((n, common + " " + " ".join(r.choice(vocab) for _ in range(r.randint(1, 60)))))
        n += 1
    for t in (None, "", " \t\n", "one", "One", "one two three", "ÀÉ x", "x" * 5000, "a b c d e", "A B C D E", "a b c d e f"):
        rows.append((n, t))
        n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds,block", [(1, 16), (3, 4_096)])
@pytest.mark.parametrize("words", [4, 5])
def test_components_match_brute_force(spark, monkeypatch, rounds, block, words):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "GROUP_BLOCK", block)
    rows = corpus(words)
    found = neardup.near_duplicates(spark.createDataFrame(rows, TEXTS), words=words)
    assert sorted(map(tuple, found.collect())) == brute(rows, words, 80)


def test_a_large_group_of_half_similar_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with an edit each: each is near the text, hardly any two are near one another."""
    r = random.Random(3)
    base = [f"w{r.randrange(10_000)}" for _ in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 800):
        text, at = list(base), r.sample(range(4, 56), 1 + i % 3)
        for j in at:
            text[j] = f"n{i}x{j}"
        rows.append((i, " ".join(text)))
    seen = []
    plain = neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *rest: (seen.append(pairs.count()), plain(pairs, *rest))[1])
    found = neardup.near_duplicates(spark.createDataFrame(rows, TEXTS), words=5)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 80)
    assert sum(seen) < 66 * len(rows)  # all pairs would be 400 a row


def test_edges(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], TEXTS)).collect() == []
    same = [(7, "p q r", "u"), (7, "p q r", "u"), (7, "s t u", "v"), (None, "n n", "w"), (None, "n n", "w")]
    kept = neardup.remove_near_duplicates(spark.createDataFrame(same, TEXTS + ", name string")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 7]
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, "w")], TEXTS + ", digest string")
    assert sorted((r.doc_id or 0, r.digest) for r in neardup.remove_near_duplicates(docs).collect()) == [(0, "z"), (1, "x"), (3, "w")]
