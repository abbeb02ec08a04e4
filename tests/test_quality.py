from pyspark.sql import functions as F

from ledgerloom.operators import quality
from small import category, ledger, profile, rows, schedule, transaction

UUID = "123e4567-e89b-42d3-a456-426614174000"


def fields(df):
    return [tuple(e.field for e in row.errors) for row in df.collect()]


def raw(spark, columns, *data):
    return spark.createDataFrame(list(data), ", ".join(f"{c} string" for c in columns.split()))


def test_transactions(spark):
    given = raw(
        spark,
        "amount type date category_id note",
        ("-1.50", "income", "2024-02-29", UUID, None),
        ("1.", "income", "2023-02-29", UUID, None),
        (None, "gift", " 2024-1-5", "", ""),
        ("99999999999", "expense", "2024-02-29T10:00:00Z", UUID.upper(), "x"),
        ("1e3", None, "20240105", None, None),
    ).coalesce(1)
    checked = quality.validate_transactions(given)
    assert fields(checked) == [
        (),
        ("amount", "date"),
        ("amount", "type", "date", "category_id"),
        ("amount",),
        ("amount", "type", "category_id"),
    ]
    valid, rejected = quality.split(checked)
    assert (valid.count(), rejected.count()) == (1, 4)
    assert dict(quality.typed_transactions(valid).dtypes)["amount"] == "decimal(12,2)"


def test_goals(spark):
    given = raw(
        spark,
        "name target_amount current_amount deadline status user_id",
        (" Car ", "0.01", None, None, None, "u"),
        ("", "0", "-0.01", "soon", "paused", ""),
        (None, None, "0", "2025-12-31", "completed", None),
        ("Car", "5e2", "1", "2025-12-31", "cancelled", "u"),
    ).coalesce(1)
    checked = quality.validate_goals(given)
    assert fields(checked) == [
        (),
        ("name", "target_amount", "current_amount", "deadline", "status", "user_id"),
        ("name", "target_amount", "user_id"),
        (),
    ]
    assert checked.first().name == "Car"


COLUMNS = "amount frequency start_date end_date category_id note is_active"


def test_schedules(spark):
    given = raw(
        spark,
        COLUMNS,
        ("0.01", "yearly", "2024-01-01", None, None, " rent ", None),
        ("0.01", "biweekly", "2024-01-01", "2024-12-31", UUID, None, "false"),
        ("0", "hourly", "soon", "later", "c", None, "yes"),
    ).coalesce(1)
    checked = quality.validate_schedules(given)
    assert fields(checked) == [
        (),
        (),
        ("amount", "frequency", "start_date", "end_date", "category_id", "is_active"),
    ]
    assert checked.first().note == "rent"


def test_investments(spark):
    start = ("5", "daily", "2024-01-01", None, None, None, "1")
    given = raw(
        spark,
        COLUMNS + " expected_return_rate investment_type",
        (*start, "-100", "Stocks"),
        (*start, None, " Bonds "),
        (*start, "1000", ""),
        (*start, "high", None),
    ).coalesce(1)
    checked = quality.validate_investments(given)
    both = ("expected_return_rate", "investment_type")
    assert fields(checked) == [(), (), both, both]


def test_constraints(spark):
    book = ledger(
        spark,
        profiles=[profile("u")],
        categories=[category("c", "u", "expense"), category("o", "ghost", "income")],
        transactions=[
            transaction(1, "u", "expense", 1, "2024-01-01", "c"),
            transaction(1, "u", "expense", 1, "2024-01-01", None),
            transaction(2, "ghost", "gift", 1, "2024-01-01", "lost"),
        ],
        fixed_costs=[schedule("f", "u", 1, "yearly", "2024-01-01", category_id="lost")],
    )
    assert sorted(rows(quality.check_constraints(book))) == [
        ("categories", "user_id reference", "o"),
        ("fixed_costs", "category_id reference", "f"),
        ("fixed_costs", "frequency domain", "f"),
        ("transactions", "category_id reference", "2"),
        ("transactions", "id unique", "1"),
        ("transactions", "type domain", "2"),
        ("transactions", "user_id reference", "2"),
    ]


def test_null_and_range_constraints(spark):
    book = ledger(spark, profiles=[profile("u")])
    broken = spark.sql(
        "SELECT '9' id, 'u' user_id, CAST(NULL AS STRING) category_id, '99999999999' amount,"
        " CAST(NULL AS STRING) note, CAST(NULL AS DATE) date, 'income' type"
    )
    found = quality.check_constraints(book.with_tables(transactions=broken))
    assert sorted(rows(found, "rule")) == [("amount range",), ("date not null",)]


def test_warnings(spark):
    book = ledger(
        spark,
        categories=[category("c", "u", "expense")],
        transactions=[
            transaction(1, "u", "income", 1, "2024-01-01", "c"),
            transaction(2, "v", "expense", 1, "2024-01-01", "c"),
            transaction(3, "u", "expense", 1, "2024-01-01", "c"),
        ],
        fixed_costs=[schedule("f", "u", 1, "daily", "2024-01-02", "2024-01-01")],
    )
    assert sorted(rows(quality.warn_inconsistencies(book))) == [
        ("fixed_costs", "end_date before start_date", "f"),
        ("transactions", "category of another user", "2"),
        ("transactions", "type differs from category", "1"),
    ]


def test_all_white_space_is_trimmed_and_rows_are_typed(spark):
    raw = spark.createDataFrame(
        [("1", "u", "\t\u00a0Trip\n\ufeff", "10.50", None, "2024-02-03", "in_progress")],
        "id string, user_id string, name string, target_amount string, current_amount string, deadline string, status string",
    )
    valid, rejected = quality.split(quality.validate_goals(raw))
    (goal,) = quality.typed_goals(valid).collect()
    assert rejected.count() == 0
    assert (goal.name, str(goal.target_amount), goal.current_amount, str(goal.deadline)) == ("Trip", "10.50", None, "2024-02-03")
    cost = spark.createDataFrame(
        [("1", "7", "yearly", "2024-01-31", None, None, "1", " \trent\n", "8.5", "Stocks")],
        "id string, amount string, frequency string, start_date string, end_date string, category_id string,"
        " is_active string, note string, expected_return_rate string, investment_type string",
    )
    valid, _ = quality.split(quality.validate_investments(cost))
    (row,) = quality.typed_schedules(valid).collect()
    assert (str(row.amount), row.frequency, str(row.start_date), row.is_active, row.note, str(row.expected_return_rate)) == (
        "7.00", "annually", "2024-01-31", True, "rent", "8.50")


def test_rates_out_of_range_are_found(spark):
    book = ledger(spark, profiles=[profile("u")], fixed_investments=[schedule("f", "u", 1, "monthly", "2024-01-01")])
    wide = book.fixed_investments.withColumn("expected_return_rate", F.lit("1000.00").cast("decimal(8,2)"))
    found = quality.check_constraints(book.with_tables(fixed_investments=wide))
    assert rows(found) == [("fixed_investments", "expected_return_rate range", "f")]
