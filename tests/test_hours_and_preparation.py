import pytest
from pyspark.sql import functions as F

from quillstone.functions import hours
from quillstone.operators import preparation as P


@pytest.mark.parametrize(
    "quote,period,want",
    [
        ("Monday - Friday 8am - 5pm", (0, "08:00", "17:00"), None), ("Monday - Friday 8am - 5pm", (5, "08:00", "17:00"), "other_day"), ("Mon-Fri 8-5pm", (2, "08:00", "17:00"), None), ("Mon-Fri 8am-5pm", (2, "09:00", "17:00"), "opening"),
        ("Mon-Fri 8am-5pm", (2, "08:00", "18:00"), "closing"), ("Saturday - Monday 10 a.m. to 2 p.m.", (6, "10:00", "14:00"), None), ("Saturday - Monday 10am to 2pm", (3, "10:00", "14:00"), "other_day"), ("8am - 5pm Monday - Friday", (4, "08:00", "17:00"), None),
        ("Mon-Fri 8am-5pm, Wednesday closed", (2, "08:00", "17:00"), "closed"), ("Mon-Fri 8am-5pm. Open late on Mondays until 9pm", (0, "08:00", "21:00"), None), ("Mon-Fri 8am-5pm. Open late on Mondays until 9pm", (0, "08:00", "17:00"), "closing"),
        ("Mon-Fri 8am-5pm; Wednesday 10am-3pm", (2, "10:00", "15:00"), None), ("Mon-Fri 8am-5pm; Wednesday 10am-3pm", (2, "08:00", "15:00"), "opening"), ("Mon, Wed & Fri 10am-1pm", (2, "10:00", "13:00"), None), ("Mon, Wed & Fri 10am-1pm", (1, "10:00", "13:00"), "other_day"),
        ("daily 8am", (0, "08:00", "09:00"), "no_days"), ("Tuesday 10:30am–4:30pm", (1, "10:30", "16:30"), None), ("Tue 1-5pm", (1, "13:00", "17:00"), None), ("Tue 10am-5pm", (1, "01:00", "17:00"), "opening"), ("Thursday 12pm-1pm", (3, "12:00", "13:00"), None),
    ],
)
def test_hours(quote, period, want):
    assert hours.unsupported(hours.parts_of(quote), *period) == want


@pytest.mark.parametrize(
    "quote,slot,reason",
    [
        ("Stop aspirin 7 days before your procedure.", "days_before", "placed"), ("Eat lightly the day before your procedure.", "day_before", "placed"), ("1 day before your test, drink water.", "day_before", "placed"), ("A week before your exam, call us.", "days_before", "placed"),
        ("Fast after midnight the night before your procedure.", "evening_before", "placed"), ("Stop drinking 2 hours before your arrival.", "hours_before", "placed"), ("Arrive at 7:00 AM on the day of your procedure.", "arrival", "placed"), ("If you cannot arrive by 7:00 AM, call.", None, "clock_without_day"),
        ("Take it the morning of your procedure.", "morning_of", "placed"), ("Rest after your procedure.", "after", "placed"), ("Take it at 8 PM.", None, "clock_without_day"), ("Take it 2 hours before bedtime.", None, "no_time_words"), ("Bring a driver.", None, "no_time_words"),
        ("Take it the day before your test and the morning of your test.", None, "conflict"), ("Take it\nthe day before your test.", None, "multi_line"), ("Drink at 5 PM the evening before your test, the day before your test.", "evening_before", "placed"), ("Your arrival time is 7:30 AM.", "arrival", "placed"),
        ("Take your pill. Stop drinking 2 hours before your procedure.", None, "no_time_words"), ("On the day of your test, drink 2 hours before your test.", "hours_before", "placed"),
    ],
)
def test_read_when(quote, slot, reason):
    assert P.read_when(quote)[:2] == (slot, reason)


PAPER = """Stop iron 5 days before your procedure. Eat lightly the day before your test.
Take your pill; stop drinking 2 hours before your procedure. Bring a driver.
5 hours before your procedure, drink the second half. Rest. Rest after your test.
If you take insulin, do not take it the morning of your procedure."""


def test_timeline(spark):
    steps = ["Stop iron", "eat lightly", "Take your pill", "Bring a driver", "drink the second half", "Rest", "do not take it", "Stop zinc", "Stop ... procedure", ""]
    df = spark.createDataFrame([(1, PAPER, list(enumerate(steps))), (2, None, [(0, "x")]), (3, "x", None)], "id int, text string, steps array<struct<row:bigint,quote:string>>")
    got = P.prep_steps(df, "id")
    by = {(r.id, r.row): (r.slot, r.reason, r.held) for r in got.collect()}
    assert by == {
        (1, 0): ("days_before", "placed", False), (1, 1): ("day_before", "placed", False), (1, 2): (None, "other_clause", False), (1, 3): (None, "no_time_words", False), (1, 4): ("hours_before", "placed", False), (1, 5): (None, "no_time_words", False),
        (1, 6): ("morning_of", "placed", False), (1, 7): (None, None, True), (1, 8): (None, None, True), (1, 9): (None, None, True), (2, 0): (None, None, True),
    }
    assert {r.slot: r.rows for r in P.timeline(got, "id").where("id = 1").collect()} == {"days_before": [0], "day_before": [1], "hours_before": [4], "morning_of": [6], None: [2, 3, 5]}


def test_hours_column(spark):
    df = spark.createDataFrame([("Mon 8am-5pm", 0), ("Mon 8am-5pm", 1), (None, 1)], "q string, d int")
    got = [r.w for r in df.select(hours.hours_check("q", "d", F.lit("08:00"), F.lit("17:00")).alias("w")).collect()]
    assert got == [None, "other_day", "no_days"]
