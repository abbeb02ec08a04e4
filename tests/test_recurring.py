import calendar
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import recurring
from small import ledger, rows, schedule

AS_OF = date(2024, 6, 30)


def dates(spark, as_of=AS_OF, mode="reference", **given):
    spec = {"id": "s", "user": "u", "amount": 10, "frequency": "monthly", "start": "2024-01-31"}
    book = ledger(spark, fixed_costs=[schedule(**{**spec, **given})])
    found = recurring.expand_fixed_costs(book, as_of, mode).orderBy("date")
    return [str(d) for (d,) in rows(found, "date")]


def test_month_end_sticks(spark):
    assert dates(spark) == [
        "2024-01-31",
        "2024-02-29",
        "2024-03-29",
        "2024-04-29",
        "2024-05-29",
        "2024-06-29",
    ]


def test_leap_day(spark):
    found = dates(spark, date(2028, 3, 1), frequency="annually", start="2024-02-29")
    assert found == ["2024-02-29", "2025-02-28", "2026-02-28", "2027-02-28", "2028-02-28"]


def test_alias_and_unknown_frequency(spark):
    assert dates(spark, frequency="yearly", start="2023-01-31") == ["2023-01-31", "2024-01-31"]
    assert dates(spark, frequency="hourly", start="2024-01-31") == ["2024-01-31"]


def test_bounds(spark):
    day = str(AS_OF)
    assert dates(spark, frequency="daily", start=day, end=day) == [day]
    assert dates(spark, end=str(AS_OF - timedelta(days=1))) == []
    assert dates(spark, start=str(AS_OF + timedelta(days=10))) == []
    assert dates(spark, is_active=None) == []
    assert dates(spark, is_active=False) == []


def test_marks(spark):
    book = ledger(
        spark,
        fixed_costs=[
            schedule("live", "u", 1, "daily", "2024-01-01"),
            schedule("ended", "u", 1, "daily", "2024-01-01", str(AS_OF - timedelta(days=1))),
            schedule("future", "u", 1, "daily", str(AS_OF + timedelta(days=10))),
            schedule("off", "u", 1, "daily", "2024-01-01", is_active=False),
        ],
    )
    moved = recurring.advance_schedules(book, AS_OF).fixed_costs
    assert dict(rows(moved, "id", "last_generated_date")) == {
        "live": AS_OF,
        "ended": None,
        "future": AS_OF,
        "off": None,
    }


def test_growth_notes_and_types(spark):
    plan = {"user": "u", "frequency": "daily", "start": str(AS_OF)}
    book = ledger(
        spark,
        fixed_investments=[
            schedule("a", amount=1000, expected_return_rate=8.5, **plan),
            schedule("b", amount=0.01, expected_return_rate=50, note="mine", **plan),
            schedule("c", amount=7, expected_return_rate=None, investment_type="Bonds", **plan),
        ],
        periodic_income=[schedule("p", amount=3, **plan)],
    )
    found = recurring.expand_all_schedules(book, AS_OF).orderBy("schedule_id")
    assert rows(found, "schedule_id", "amount", "note", "type") == [
        ("a", "1085.00", "Auto-generated investment: Stocks", "investment"),
        ("b", "0.02", "mine", "investment"),
        ("c", "7.00", "Auto-generated investment: Bonds", "investment"),
        ("p", "3.00", "Auto-generated periodic income", "income"),
    ]


def test_running_twice(spark):
    book = ledger(spark, fixed_costs=[schedule("s", "u", 1, "monthly", "2024-01-15")])
    for mode, extra in (("reference", [AS_OF]), ("anchored", [])):
        once = recurring.run_schedules(book, AS_OF, mode)
        assert once.transactions.count() == 6
        again = recurring.expand_all_schedules(once, AS_OF, mode)
        assert [d for (d,) in rows(again, "date")] == extra
        twice = recurring.run_schedules(once, AS_OF, mode).transactions
        assert twice.select("id").distinct().count() == twice.count()
    later = recurring.expand_all_schedules(once, date(2024, 9, 1), "anchored").orderBy("date")
    assert [str(d) for (d,) in rows(later, "date")] == ["2024-07-15", "2024-08-15"]


def test_future_start_never_generates_early_when_anchored(spark):
    book = ledger(spark, fixed_costs=[schedule("s", "u", 1, "weekly", "2024-07-10")])
    marked = recurring.advance_schedules(book, AS_OF)
    assert recurring.expand_all_schedules(marked, date(2024, 7, 9), "anchored").count() == 0
    found = recurring.expand_all_schedules(marked, date(2024, 7, 18), "anchored").orderBy("date")
    assert [str(d) for (d,) in rows(found, "date")] == ["2024-07-10", "2024-07-17"]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        recurring.expand(ledger(spark), "fixed_costs", AS_OF, "hasty")


def stepped(start, frequency, stop):
    """Dates found by stepping one by one."""
    found, day = [], start
    while day <= stop:
        found.append(day)
        if frequency in recurring.DAY_STEPS:
            day += timedelta(days=recurring.DAY_STEPS[frequency])
        else:
            number = day.year * 12 + day.month - 1 + recurring.MONTH_STEPS[frequency]
            year, month = divmod(number, 12)
            last = calendar.monthrange(year, month + 1)[1]
            day = date(year, month + 1, min(day.day, last))
    return found


@pytest.mark.parametrize("mode", recurring.MODES)
def test_against_stepping(spark, mode):
    draw = random.Random(7)
    frequencies = [*recurring.DAY_STEPS, *recurring.MONTH_STEPS]
    plans, as_of = [], date(2105, 3, 31)
    for i in range(300):
        frequency = draw.choice(frequencies)
        span = 900 if frequency in recurring.DAY_STEPS else 12000
        start = as_of - timedelta(days=draw.randrange(span))
        if draw.random() < 0.6:
            start = start.replace(day=calendar.monthrange(start.year, start.month)[1])
        mark = start + timedelta(days=draw.randrange(-50, 900)) if draw.random() < 0.4 else None
        plans.append((str(i), frequency, start, mark))
    book = ledger(
        spark,
        fixed_costs=[
            schedule(i, "u", 1, f, str(s), mark=m and str(m)) for i, f, s, m in plans
        ],
    )
    expected = {}
    for i, frequency, start, mark in plans:
        if mode == "reference":
            expected[i] = stepped(mark or start, frequency, as_of)
        else:
            expected[i] = [d for d in stepped(start, frequency, as_of) if not mark or d > mark]
    found = (
        recurring.expand_fixed_costs(book, as_of, mode)
        .groupBy("schedule_id")
        .agg(F.sort_array(F.collect_list("date")).alias("dates"))
    )
    assert {r.schedule_id: r.dates for r in found.collect()} == {
        i: d for i, d in expected.items() if d
    }
