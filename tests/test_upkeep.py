"""Changes to stored ledgers, the rollup kept under them, and broken-off writes."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

import pytest

from ledgerloom.operators import changes, reports
from ledgerloom.plans import balance, upkeep
from ledgerloom.plans.activity import activity, monthly_rollup
from ledgerloom.sources import parquet, upkeep as stored
from ledgerloom.sources.parquet import read_ledger, write_ledger, write_rollup
from small import category, ledger, profile, rows, transaction

COLUMNS = ("user_id", "category_id", "type", "date", "amount", "n", "last_date")


def book(spark):
    return ledger(
        spark,
        profiles=[profile("u", 3), profile("v")],
        categories=[category("c", "u", "expense"), category("d", "v", "income")],
        transactions=[
            transaction(1, "u", "expense", 1, "2022-12-31", "c"),
            transaction(2, "u", "expense", 2, "2023-01-01", "c"),
            transaction(3, "u", "expense", 4, "2023-01-20", "c"),
            transaction(4, "u", "expense", 8, "2023-01-20", "c"),
            transaction(5, "v", "income", 16, "2024-05-05", "c"),
            transaction(6, "u", "income", 32, "2024-05-06"),
        ],
    )


def keys(spark, *ids):
    return spark.createDataFrame(list(ids), "id string, user_id string")


def fresh(book_):
    return sorted(rows(monthly_rollup(activity(book_.with_tables(transactions=book_.transactions))), *COLUMNS), key=str)


def with_rollup(book_):
    return book_.with_tables(monthly_activity=monthly_rollup(activity(book_)))


def check(book_, change):
    after = upkeep.changed(with_rollup(book_), change)
    assert sorted(rows(after.monthly_activity, *COLUMNS), key=str) == fresh(after)
    return after


def test_retracted_latest_dates_are_found_again(spark):
    b = book(spark)
    one = check(b, upkeep.deleted(b.transactions, keys(spark, ("3", "u"))))  # another is as late
    assert ("u", "c", "expense", date(2023, 1, 1), "10.00", 2, date(2023, 1, 20)) in fresh(one)
    both = check(b, upkeep.deleted(b.transactions, keys(spark, ("3", "u"), ("4", "u"))))
    assert ("u", "c", "expense", date(2023, 1, 1), "2.00", 1, date(2023, 1, 1)) in fresh(both)
    check(b, upkeep.deleted(b.transactions, keys(spark, ("2", "u"), ("3", "u"), ("4", "u"))))
    check(b, upkeep.deleted(b.transactions, keys(spark, ("6", "u"), ("1", "v"))))  # no category; not the owner


def test_updates_and_inserts(spark):
    b = book(spark)
    batch = spark.createDataFrame(
        [("4", "u", date(2023, 1, 5), "c", Decimal(9)), ("2", "u", date(2021, 2, 2), None, Decimal(1)), ("5", "v", date(2024, 5, 31), "d", Decimal(3))],
        "id string, user_id string, date date, category_id string, amount decimal(12,2)",
    )
    check(b, upkeep.updated(b.transactions, batch))
    new = spark.createDataFrame([("7", "u", "expense", 5, date(2023, 1, 31)), ("8", "w", "income", 6, None)], "id string, user_id string, type string, amount int, date date")
    check(b, upkeep.inserted(b.transactions, new, date(2020, 1, 1)))


def test_random_changes(spark):
    rng = random.Random(4)
    day = lambda: str(date(2023, 1, 1) + timedelta(days=rng.randrange(75)))
    data = [transaction(i, rng.choice("uv"), rng.choice(["income", "expense"]), rng.randrange(-5, 9), day(), rng.choice(["c", "d", None])) for i in range(150)]
    b = ledger(spark, transactions=data)
    picked = rng.sample(data, 40)
    batch = spark.createDataFrame(
        [(t["id"], t["user_id"], date.fromisoformat(day()), rng.choice(["c", None])) for t in picked[:20]],
        "id string, user_id string, date date, category_id string",
    )
    change = upkeep.updated(b.transactions, batch).then(upkeep.deleted(b.transactions, keys(spark, *[(t["id"], t["user_id"]) for t in picked[20:]])))
    check(b, change)


def test_taking_away_what_was_never_there_raises(spark):
    b = with_rollup(book(spark))
    other = ledger(spark, transactions=[transaction(9, "u", "expense", 1, "2019-01-01")]).transactions
    kept = upkeep.rollup_after(b.monthly_activity, upkeep.RowChange(other, other.where("false")), b.transactions)
    with pytest.raises(Exception, match="does not hold"):
        kept.collect()


def files(root, name="transactions"):
    return {str(p.relative_to(root)) for p in Path(root, name).rglob("*.parquet")}


def written(spark, tmp_path, rollup=True):
    root = str(tmp_path / "ledger")
    write_ledger(book(spark), root)
    if rollup:
        write_rollup(book(spark), root)
    return root


def test_only_touched_years_are_rewritten(spark, tmp_path):
    root = written(spark, tmp_path)
    before, rolled = files(root), files(root, "monthly_activity")
    years = stored.change_stored(spark, root, lambda b: upkeep.deleted(b.transactions, keys(spark, ("4", "u"))))
    assert years == [2023]
    for was, name in ((before, "transactions"), (rolled, "monthly_activity")):
        now = files(root, name)
        assert {f for f in was if "=2023" not in f} == {f for f in now if "=2023" not in f}
        assert not {f for f in was if "=2023" in f} & now
    after = read_ledger(spark, root, rollup=True)
    assert sorted(rows(after.monthly_activity, *COLUMNS), key=str) == fresh(after)
    raw = reports.annual_trend(read_ledger(spark, root), 2023, "u")
    assert rows(raw, "month_number", "expense_running_total") == rows(reports.annual_trend(after, 2023, "u"), "month_number", "expense_running_total")


def test_a_year_can_lose_all_its_rows_and_a_new_one_come(spark, tmp_path):
    root = written(spark, tmp_path)
    moved = spark.createDataFrame([("5", "v", date(2030, 1, 1)), ("6", "u", date(2030, 1, 2))], "id string, user_id string, date date")
    assert stored.change_stored(spark, root, lambda b: upkeep.updated(b.transactions, moved)) == [2024, 2030]
    after = read_ledger(spark, root, rollup=True)
    assert sorted(rows(after.transactions, "id", "date_year")) == [("1", 2022), ("2", 2023), ("3", 2023), ("4", 2023), ("5", 2030), ("6", 2030)]
    assert sorted(rows(after.monthly_activity, *COLUMNS), key=str) == fresh(after)
    assert after.transactions.where("date_year = 2024").count() == 0
    assert stored.change_stored(spark, root, lambda b: upkeep.deleted(b.transactions, keys(spark, ("1", "nobody")))) == []


def test_cascade_rewrites_the_other_tables_too(spark, tmp_path):
    root = written(spark, tmp_path)
    users = spark.createDataFrame([("u",)], "user_id string")
    stored.change_stored(spark, root, lambda b: stored.cascade(b, users))
    after = read_ledger(spark, root, rollup=True)
    expected = changes.delete_profiles_cascade(book(spark), users)
    for name, table in expected.tables().items():
        assert sorted(rows(getattr(after, name).select(table.columns)), key=str) == sorted(rows(table), key=str), name
    assert sorted(rows(after.monthly_activity, *COLUMNS), key=str) == fresh(after)


@pytest.mark.parametrize("at", [0, 1])
def test_a_change_broken_off_while_moving_in_is_finished(spark, tmp_path, monkeypatch, at):
    root = written(spark, tmp_path)
    real, calls = stored._replace_years, []

    def breaks(*args):
        calls.append(args)
        if len(calls) > at:
            raise OSError("the writer died")
        real(*args)

    monkeypatch.setattr(stored, "_replace_years", breaks)
    moved = spark.createDataFrame([("3", "u", date(2024, 1, 1))], "id string, user_id string, date date")
    with pytest.raises(OSError):
        stored.change_stored(spark, root, lambda b: upkeep.updated(b.transactions, moved))
    with pytest.raises(ValueError, match="broken off"):
        read_ledger(spark, root)
    monkeypatch.setattr(stored, "_replace_years", real)
    assert stored.finish_changes(spark, root) and not stored.finish_changes(spark, root)
    after = read_ledger(spark, root, rollup=True)
    assert dict(rows(after.transactions, "id", "date"))["3"] == date(2024, 1, 1)
    assert after.transactions.count() == 6
    assert sorted(rows(after.monthly_activity, *COLUMNS), key=str) == fresh(after)


def test_a_change_broken_off_earlier_leaves_the_ledger_as_it_was(spark, tmp_path, monkeypatch):
    root = written(spark, tmp_path)
    monkeypatch.setattr(stored, "append_version", lambda *a, **k: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        stored.change_stored(spark, root, lambda b: upkeep.deleted(b.transactions, keys(spark, ("1", "u"))))
    assert read_ledger(spark, root, rollup=True).transactions.count() == 6


def test_years_are_written_once_and_renamed(spark, tmp_path, monkeypatch):
    """Also where the writer died between the old year's going and the new one's coming."""
    root = written(spark, tmp_path)
    real, died = stored._replace, []

    def dies(spark, path, staged):
        if not died:
            died.append((path, staged, files(staged, "")))
            files_ = stored._files(spark, path)
            files_.delete(stored._path(spark, path), True)
            raise OSError("the writer died")
        real(spark, path, staged)

    monkeypatch.setattr(stored, "_replace", dies)
    with pytest.raises(OSError):
        stored.change_stored(spark, root, lambda b: upkeep.deleted(b.transactions, keys(spark, ("4", "u"))))
    assert stored.finish_changes(spark, root)
    path, staged, there = died[0]
    assert there and files(path, "") == there and not Path(staged).exists()
    after = read_ledger(spark, root, rollup=True)
    assert sorted(rows(after.transactions, "id")) == [(i,) for i in "12356"]
    assert sorted(rows(after.monthly_activity, *COLUMNS), key=str) == fresh(after)


def test_the_rollup_after_a_change_is_grouped_once(spark, tmp_path):
    root = written(spark, tmp_path)
    b = read_ledger(spark, root, rollup=True)
    change = upkeep.deleted(b.transactions, keys(spark, ("4", "u")))
    text = upkeep.rollup_after(b.monthly_activity, change, b.transactions)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^]]*last_date#", text)) == 1


def test_a_stale_rollup_stays_stale(spark, tmp_path):
    root = written(spark, tmp_path)
    write_ledger(book(spark), root)
    stored.change_stored(spark, root, lambda b: upkeep.deleted(b.transactions, keys(spark, ("1", "u"))))
    assert read_ledger(spark, root).transactions.count() == 5
    with pytest.raises(ValueError, match="older tables"):
        read_ledger(spark, root, rollup=True)


def test_writers_that_die_are_noticed(spark, tmp_path, monkeypatch):
    root = written(spark, tmp_path)
    real = parquet.write_table

    def dies(name, table, path):
        if name == "financial_goals":
            raise OSError("the writer died")
        real(name, table, path)

    monkeypatch.setattr(parquet, "write_table", dies)
    with pytest.raises(OSError):
        write_ledger(book(spark).with_tables(transactions=book(spark).transactions.where("id = '1'")), root)
    for rollup in (False, True):
        with pytest.raises(ValueError, match="broken off"):
            read_ledger(spark, root, rollup=rollup)
    monkeypatch.setattr(parquet, "write_table", real)
    write_ledger(book(spark), root)
    assert read_ledger(spark, root).transactions.count() == 6


def test_the_rollup_is_of_what_is_stored(spark, tmp_path, monkeypatch):
    root = written(spark, tmp_path, rollup=False)
    write_rollup(book(spark).with_tables(transactions=book(spark).transactions.where("id = '1'")), root)
    after = read_ledger(spark, root, rollup=True)
    assert sorted(rows(after.monthly_activity, *COLUMNS), key=str) == fresh(after) and len(fresh(after)) == 4
    monkeypatch.setattr(parquet, "_write_by_year", lambda *a, **k: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        write_rollup(book(spark), root)
    with pytest.raises(ValueError, match="never finished"):
        read_ledger(spark, root, rollup=True)


def test_a_change_reads_the_touched_years_alone(spark, tmp_path, monkeypatch):
    root = written(spark, tmp_path)
    plans = []
    real = upkeep.after
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(stored.upkeep, "after", lambda t, c: plans.append(text(real(t, c))) or real(t, c))
    stored.change_stored(spark, root, lambda b: upkeep.deleted(b.transactions, keys(spark, ("1", "u"))))
    assert re.search(r"PartitionFilters: \[[^]]*date_year#\d+ = 2022", plans[0])


def balances(spark, book_):
    return sorted(rows(reports.all_time_balance(book_)), key=str)


def test_back_dated_rows_in_the_two_level_balance(spark):
    b = book(spark)
    kept = balance.balance_of(b.transactions)
    assert sorted(rows(balance.report(kept, b.profiles)), key=str) == balances(spark, b)
    new = spark.createDataFrame([("7", "u", "income", 100, date(2020, 6, 1)), ("8", "new", "expense", 5, date(2023, 1, 9))], "id string, user_id string, type string, amount int, date date")
    change = upkeep.inserted(b.transactions, new, date(2020, 1, 1)).then(upkeep.deleted(b.transactions, keys(spark, ("1", "u"), ("5", "v"))))
    later = b.with_tables(transactions=upkeep.after(b.transactions, change))
    again = balance.after(kept, change, later.transactions)
    assert sorted(rows(balance.report(again, b.profiles)), key=str) == balances(spark, later)
    # Carries: a row for each user and active year, what came before it.
    assert sorted(rows(again.carries.where("user_id = 'u'"), "year", "carried")) == [(2020, "0.00"), (2023, "100.00"), (2024, "86.00")]
