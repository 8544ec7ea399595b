"""Faults of round 4 that must not come back."""

from quillstone.llm import neardup


def test_near_duplicates_broadcast_no_more_than_the_bound(spark, monkeypatch):
    """Exploded signatures are some 30 times what Spark takes them for, so no join may go by its estimates."""
    plans, plain = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: (plans.append(df), plain(df, name))[1])
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 4)
    monkeypatch.setattr(neardup, "SENT_ROWS", 0, raising=False)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"n{i}x{j}" for j in range(i % 9)] + words[30 + i % 3 :])) for i in range(40)] + [(50, None), (7, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans.append(neardup.near_duplicates(docs))
    assert len(plans) > 10
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_equal_quotes_of_a_text_are_looked_for_once(monkeypatch):
    import pyarrow as pa

    from quillstone.operators import grounding

    asked, plain = [], grounding.found_row
    monkeypatch.setattr(grounding, "found_row", lambda *x: asked.append(x[2]) or plain(*x))
    rows = [("Take 5 mg now.\nRest.", q) for q in ("5 mg", "Rest.", None, "6 mg", "Take ... now", "") for _ in range(50)] + [(None, "5 mg"), ("5 mg", "5 mg")]

    class Pairs:
        dtypes = [("text", "string"), ("quote", "string")]

        def mapInArrow(self, f, schema):  # noqa: N802
            return pa.Table.from_batches(f([pa.RecordBatch.from_pylist([{"text": t, "quote": q} for t, q in rows])])).to_pylist()

    got = grounding.ground(Pairs(), ["text", "quote"])
    assert len(asked) == 8
    expected = [plain(grounding.Source(t or ""), t or "", q or "") for t, q in rows]
    assert [(r["start"], r["end"], r["exact"], r["ranges"]) for r in got] == expected


def test_values_are_the_same_by_the_short_way(spark):
    """amounts reads digits alone where a text can have nothing else."""
    from pyspark.sql import functions as F

    from quillstone.operators import drafts

    texts = [None, "", "5 cups", "item 3 with 5 cups", "1,000 mg or 1,5", "none", "Two and 2", "TWENTY five", "1 1/2 cups", "3 ⁄ 4", "½ cup", "a quarter of 8", "Media hora", "un quart", "one hundred and 5", "٣ cups 3", "5 5 6", "x5.5y", "demie 7", "first 1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", drafts.amounts(F.col("t")).alias("a"), drafts.all_amounts(F.col("t")).alias("b"), F.transform(F.array("t"), drafts.amounts)[0].alias("c")).collect()
    assert all(r.a == r.b == r.c for r in rows), rows
    assert rows[3].a == ["3", "5"] and rows[8].a == ["1 1/2"]


def test_merged_intervals_are_those_of_the_sql_where_times_are_null(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    from quillstone.plans import registry

    rows = [(1, 0, 2.0), (1, None, 3.0), (1, 10, 1.0), (1, 90, None), (1, 90, 1.0), (2, None, 1.0), (2, None, None), (3, 5, None), (3, 6, 1.0), (None, 7, 1.0)]
    ts = F.expr("timestampadd(MINUTE, m, TIMESTAMP_NTZ '2020-01-01 00:00:00')").alias("ts")
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, m int, value double").select("event_id", ts, "user_id", F.lit("view").alias("event_type"), "value", F.lit("").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = registry.queries()["merged_intervals"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(registry.oracle_sql()["merged_intervals"]).fetchall()))


def test_close_words_of_a_page_are_compared_together(monkeypatch):
    """No pair of words is a call of its own; words of 64 letters and more still go one by one."""
    import random

    from quillstone.operators import alignment as A

    r = random.Random(4)
    words = sorted({"".join(r.choice("abcé漢😀") for _ in range(r.choice([4, 5, 8, 9, 13]))) for _ in range(300)})
    read = sorted({w[:k] + r.choice(["", "x", "a"]) + w[k + 1 :] for w in words for k in (1, 3)} | set(words[::3]))
    far = {w: sorted(v for v in read if v != w and len(v) >= 4 and A.within(w, v, max(len(w), len(v)) // 4)) for w in words}
    asked, plain = [], A.within
    monkeypatch.setattr(A, "within", lambda *x: asked.append(x) or plain(*x))
    assert {w: sorted(some) for w, some in A.close_words(words, read).items()} == {w: some for w, some in far.items() if some}
    assert not asked
    long = "a" * 70
    assert A.close_words([long], [long + "b"]) == {long: [long + "b"]} and asked
