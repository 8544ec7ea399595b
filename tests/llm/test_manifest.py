import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def up(level):
    return [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append(levels_of([leaf(*r) for r in by[name]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(by[name]):
            way = siblings(trees[k], i) + siblings(top, k)
            altered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r[0], r[1].translate(lower) if altered else r[1], *r[2:])
            for left, right in way:
                now = sha("".join(left) + now + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in way))
            out.append((r[0], leaf(*r), trees[k][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def table(seed, n, langs):
    r = random.Random(seed)
    rows = [(i, r.choice(["Ab", "ab", None, "", "É x", "x" * 50]) and f"{r.choice('aB')}{i}", r.choice(langs), r.choice([None, "s", ""]), r.choice([None, i])) for i in range(n)]
    rows += [(7, "same", langs[0], "s", 4)] * (n // 3) + [(None, "N", None, None, None), (None, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_a_partition", [30, 1_000_000])
@pytest.mark.parametrize("n,langs", [(0, ["en"]), (1, ["en"]), (8, ["en"]), (9, ["en"]), (500, ["en", None, "de", "zh", "É"]), (300, [f"l{k}" for k in range(90)])])
def test_proofs_match_brute_force(spark, tmp_path, monkeypatch, rows_a_partition, n, langs):
    monkeypatch.setattr(manifest, "ROWS_A_PARTITION", rows_a_partition)
    rows = table(n, n, langs)[: None if n > 1 else n]
    spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", leaf string").write.parquet(str(tmp_path / "documents.parquet"))
    found = manifest.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    root = manifest.manifest_root(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert root == (want[0][3] if want else None)


def test_merging_is_associative_and_commutative():
    r = random.Random(2)
    widths = [1, 8, 9, 65, 200, 1, 3]
    trees = [[sha(f"{t}.{i}").encode() for i in range(w)] for t, w in enumerate(widths)]
    want = levels_of([levels_of([x.decode() for x in t])[-1][0] for t in trees])[-1][0]
    for _ in range(25):
        parts = []
        for t, nodes in enumerate(trees):
            cuts = sorted({0, len(nodes), *(r.randrange(len(nodes) + 1) for _ in range(4))})
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = manifest.Forest(len(trees))
                part.widths[t] = len(nodes)
                root = part.fold(t, a, b"".join(nodes[a:b]))
                if root is not None:
                    del part.widths[t]
                    part.open[manifest.TOP, 0][t] = root
                parts.append(part)
        while len(parts) > 1:
            r.shuffle(parts)
            parts.append(parts.pop().merge(parts.pop()))
        assert {k: dict(v) for k, v in parts[0].open.items()} == {(manifest.TOP, 1): {0: want.encode()}}


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(100)], DOCS)
    rows = manifest.prove(docs, F.when(F.col("doc_id") == 42, F.lit("forged"))).collect()
    assert [r.doc_id for r in rows if not r.verified] == [42] and len({r.root for r in rows}) == 1
    assert all((r.folded_root == r.root) == r.verified for r in rows)
