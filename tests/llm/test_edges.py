"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns of clashing names, operator by operator."""

import collections

import pytest
from pyspark.sql import functions as F

from quillstone.llm import chat, decontaminate, mixing, neardup, ppm, secrets, sharding, toxicity

#: Names that the operators use inside, and names of their output columns.
CLASHES = ["total", "block", "upto", "cell", "key", "row", "at", "known", "more", "mark", "terms", "counts", "toxic", "digest", "signature", "label", "_source", "_t", "_row", "of", "cdf", "chunks", "slot", "copy", "score", "secrets", "hits"]
TEXTS = [(1, None), (2, ""), (2, ""), (2, ""), (None, "token: abcdef99 x"), (None, "token: abcdef99 x"), (5, "word " * 30_000), (6, "Ünï\tçode\x00 end"), (7, "a b c d e f"), (8, "a b c d e f")]
ITEMS = [(1, "a b c"), (None, "a b c"), (3, None), (3, "zzz")]
LABELS = [(1, 0), (2, 1), (5, 0), (None, 1), (7, None)]


def extra(df):
    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES])


OPERATORS = {
    "mix": lambda s, d: mixing.mix_sources(d, total=40.0, by="rows"),
    "shard": lambda s, d: sharding.shard_uniform(d, 3),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, s.createDataFrame(LABELS, "doc_id long, toxic int")),
    "decontaminate": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame(ITEMS, "item_id long, text string")),
    "ppm": lambda s, d: ppm.score_texts(d, F.col("doc_id") != 6),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "near": lambda s, d: neardup.remove_near_duplicates(d),
}
REPLACED = {"mix": {"copy"}, "shard": {"slot"}, "toxicity": {"score"}, "decontaminate": {"hits"}, "ppm": {"score"}, "secrets": {"secrets"}, "near": set()}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    rows = OPERATORS[name](spark, extra(docs)).collect()
    for r in rows:
        assert all(r[c] == f"x-{c}" for c in CLASHES if c not in REPLACED[name])
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "near":
        assert ids == {1: 1, 2: 1, None: 1, 5: 1, 6: 1, 7: 1}  # one row of rows that repeat, one of two near copies
    elif name != "mix":
        assert ids == collections.Counter(i for i, _ in TEXTS)
    if name in ("toxicity", "ppm"):  # equal texts, equal scores
        by = collections.defaultdict(set)
        for r in rows:
            by[dict(TEXTS[:3] + TEXTS[6:]).get(r.doc_id, "?")].add(r.score)
        assert all(len(s) == 1 for s in by.values())
    assert OPERATORS[name](spark, extra(docs.limit(0))).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = extra(spark.createDataFrame([(i, t, "en", "s" if i else None, 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame(LABELS, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "token blocks":
            assert out.columns == docs.columns, name
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out.collect()


def test_chat_ties_and_clashing_columns(spark):
    rows = [(1, 0, "user", t) for t in "abcd"] + [(1, 0, "user", "a"), (2, None, None, None), (3, 1, "user", "x " * 200_000)]
    turns = extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r.rendered for r in chat.render_conversations(turns).collect()}
    import hashlib

    order = sorted("abcd", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got[1] == "".join(f"<|user|>\n{t}\n<|end|>\n" for t in order) and got[2] == "<||>\n\n<|end|>\n" and len(got[3]) > 400_000


def test_many_matches_take_linear_time(spark):
    import time

    text = "token=abcdef12 " * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    found = secrets.scan_secrets(docs).select(F.size("secrets").alias("n"), F.element_at("secrets", -1).alias("last")).first()
    assert (found.n, found.last.start, found.last.end) == (20_000, 15 * 19_999, 15 * 19_999 + 14)
    assert time.perf_counter() - began < 60
