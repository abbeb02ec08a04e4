"""Summing reports.

Every result starts with ``user_id``.  Results are unordered unless ``user_id``
is given (one user's report, in the documented order) or ``ordered=True``:
a total order over all users costs a range shuffle few batch consumers need.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import money, net_of_all, percent, share, sum_of_type, total
from ledgerloom.functions.periods import (
    month_name,
    month_period,
    months_shown,
    within,
    year_period,
)
from ledgerloom.functions.skew import attach_totals
from ledgerloom.model import MONEY, PERCENT, TRANSACTION_TYPES, Ledger
from ledgerloom.plans.activity import activity, by_category, totals_by
from ledgerloom.plans.ranking import (
    OTHERS_ICON_ALL_TIME,
    OTHERS_ICON_BY_YEAR,
    latest,
    named_groups,
    others_entry,
    top_by_year,
    top_with_others,
)



def _of_user(df: DataFrame, user_id: object | None, column: str = "user_id") -> DataFrame:
    return df if user_id is None else df.where(F.col(column) == F.lit(user_id))


def _arranged(df: DataFrame, user_id: object | None, ordered: bool, *order) -> DataFrame:
    return df.orderBy("user_id", *order) if ordered or user_id is not None else df


# --- one month -------------------------------------------------------------


def monthly_calendar(
    ledger: Ledger, year: int, month: int, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Each categorised transaction of the month, with the month's totals.

    The totals cover uncategorised rows too, which the listing leaves out.
    """
    rows = within(_of_user(ledger.transactions, user_id), month_period(year, month))
    totals = totals_by(rows, "user_id").select(
        "user_id",
        F.col("income").alias("month_total_income"),
        F.col("expense").alias("month_total_expense"),
        F.col("investment").alias("month_total_investment"),
        net_of_all().alias("month_net_balance"),
    )
    labels = ledger.categories.select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("icon").alias("category_icon"),
        F.col("color").alias("category_color"),
    )
    details = rows.where(F.col("category_id").isNotNull()).join(labels, "category_id")
    report = attach_totals(details, totals, "user_id").select(
        "user_id",
        F.col("id").alias("transaction_id"),
        F.col("date").alias("transaction_date"),
        "category_id",
        "category_name",
        "category_icon",
        "category_color",
        F.col("amount").cast(MONEY).alias("amount"),
        F.col("type").alias("transaction_type"),
        "note",
        "month_total_income",
        "month_total_expense",
        "month_total_investment",
        "month_net_balance",
    )
    return _arranged(
        report, user_id, ordered, F.desc("transaction_date"), F.desc("transaction_id")
    )


def _own_amounts(ledger: Ledger, rows: DataFrame) -> DataFrame:
    """Amount per user and own category; categories without rows are left out."""
    own = ledger.categories.select(
        F.col("id").alias("category_id"),
        "user_id",
        F.col("name").alias("category_name"),
        F.col("icon").alias("category_icon"),
        F.col("color").alias("category_color"),
        F.col("type").alias("category_type"),
    )
    return by_category(rows).join(own, ["user_id", "category_id"])


def _bases_by_category_type(per_category: DataFrame) -> DataFrame:
    """Per user the sum over each type of *category*: the bases of shares."""
    return per_category.groupBy("user_id").agg(
        *[sum_of_type(t, by="category_type").alias(f"of_{t}") for t in TRANSACTION_TYPES]
    )


def _base_of_row() -> Column:
    """The share base matching the row's category type."""
    base = F.lit(None).cast(MONEY)
    for t in TRANSACTION_TYPES:
        base = F.when(F.col("category_type") == t, F.col(f"of_{t}")).otherwise(base)
    return base


def monthly_report(
    ledger: Ledger, year: int, month: int, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """R2: month totals, and each category's amount and share of its type."""
    rows = activity(ledger, month_period(year, month), user_id)
    per_category = _own_amounts(ledger, rows)
    totals = totals_by(rows, "user_id").join(_bases_by_category_type(per_category), "user_id")
    shown = attach_totals(per_category.where(F.col("amount") > 0), totals, "user_id")
    report = shown.select(
        "user_id",
        F.col("income").alias("total_income"),
        F.col("expense").alias("total_expense"),
        F.col("investment").alias("total_investment"),
        net_of_all().alias("net_balance"),
        "category_name",
        "category_icon",
        "category_color",
        "category_type",
        F.col("amount").alias("category_amount"),
        share(F.col("amount"), _base_of_row()).alias("category_percentage"),
    )
    return _arranged(report, user_id, ordered, "category_type", F.desc("category_amount"))


def category_breakdown(
    ledger: Ledger, year: int, month: int, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Each category's amount and share in a month."""
    rows = activity(ledger, month_period(year, month), user_id)
    per_category = _own_amounts(ledger, rows)
    bases = _bases_by_category_type(per_category)
    shown = attach_totals(per_category.where(F.col("amount") > 0), bases, "user_id")
    report = shown.select(
        "user_id",
        "category_id",
        "category_name",
        F.col("amount").alias("total_amount"),
        share(F.col("amount"), _base_of_row()).alias("percentage"),
    )
    return _arranged(report, user_id, ordered, F.desc("total_amount"), "category_id")


def monthly_summary_nested(
    ledger: Ledger, year: int, month: int, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Month totals with each category, a row per user and category.

    A user without categorised amounts has one row, with no category.  For the
    nested object of one user see ``monthly_summary_of_user``.
    """
    rows = activity(ledger, month_period(year, month), user_id)
    totals = totals_by(rows, "user_id")
    shown = _own_amounts(ledger, rows).where(F.col("amount") > 0)
    entries = shown.select(
        F.col("user_id").alias("__user"),
        "category_id",
        "category_name",
        F.col("amount").alias("total_amount"),
    )
    report = totals.join(entries, F.col("user_id") == F.col("__user"), "left").select(
        "user_id",
        F.col("income").alias("total_income"),
        F.col("expense").alias("total_expense"),
        (F.col("income") - F.col("expense")).cast(MONEY).alias("net_savings"),
        "category_id",
        "category_name",
        "total_amount",
    )
    return _arranged(report, user_id, ordered, F.desc("total_amount"), "category_id")


def monthly_summary_of_user(ledger: Ledger, year: int, month: int, user_id: object) -> DataFrame:
    """D4 for one given user: one row with the categories as an array, largest first.

    The array has an entry for each of that user's categories in the month.
    """
    rows = monthly_summary_nested(ledger, year, month, user_id)
    item = F.struct(
        (-F.col("total_amount")).alias("order"), "category_id", "category_name", "total_amount"
    )
    entries = F.collect_list(F.when(F.col("category_id").isNotNull(), item))
    return rows.groupBy("user_id", "total_income", "total_expense", "net_savings").agg(
        F.transform(
            F.sort_array(entries),
            lambda c: F.struct(c["category_id"], c["category_name"], c["total_amount"]),
        ).alias("categories")
    )


# --- one year --------------------------------------------------------------


def category_trend(
    ledger: Ledger,
    year: int,
    as_of: date,
    category_id: object | None = None,
    user_id: object | None = None,
    ordered: bool = False,
) -> DataFrame:
    """A category's months with amount, and its latest transaction in the year."""
    own = _of_user(_of_user(ledger.categories, user_id), category_id, "id").select(
        "user_id",
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("icon").alias("category_icon"),
        F.col("color").alias("category_color"),
        F.col("type").alias("category_type"),
    )
    rows = activity(ledger, year_period(year), user_id)
    rows = _of_user(rows, category_id, "category_id").where(F.col("category_id").isNotNull())
    monthly = rows.groupBy("user_id", "category_id", F.month("date").alias("month")).agg(
        total(F.col("amount")).alias("amount"), F.max("last_date").alias("last_date")
    )
    # At most 12 entries per category.
    yearly = monthly.groupBy("user_id", "category_id").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "amount"))).alias("by_month"),
        F.max("last_date").alias("latest_transaction_date"),
    )
    latest_date = F.col("latest_transaction_date")
    report = (
        own.join(yearly, ["user_id", "category_id"], "left")
        .withColumn("month", _spine(months_shown(year, as_of)))
        .select(
            "user_id",
            "category_id",
            "month",
            month_name(F.col("month")).alias("month_name"),
            money(F.try_element_at("by_month", F.col("month"))).alias("amount"),
            "category_name",
            "category_icon",
            "category_color",
            "category_type",
            F.when(
                F.month(latest_date) == F.col("month"),
                F.date_format(latest_date, "dd.MM yyyy (EEE)"),
            )
            .otherwise("")
            .alias("date_label"),
            "latest_transaction_date",
        )
    )
    return _arranged(report, user_id, ordered, "category_id", "month")


def _spine(months: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(months)))


def _year_by_user(ledger: Ledger, year: int, user_id: object | None) -> DataFrame:
    """One row per active user: full-year totals and a map of up to 12 months."""
    rows = activity(ledger, year_period(year), user_id)
    monthly = totals_by(rows, "user_id", F.month("date").alias("month"))
    sums = F.struct("income", "expense", "investment")
    return monthly.groupBy("user_id").agg(
        *[total(F.col(t)).alias(f"{t}_year_total") for t in TRANSACTION_TYPES],
        F.map_from_entries(F.collect_list(F.struct("month", sums.alias("sums")))).alias("by_month"),
    )


def _with_running_totals(by_user: DataFrame, months: int) -> DataFrame:
    """The first months of each user's year with amounts and running totals.

    The window is over 12 rows per user and reuses the partitioning by user.
    """
    so_far = (
        Window.partitionBy("user_id")
        .orderBy("month_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    month = F.col("month_number")
    sums = F.try_element_at("by_month", month)
    rows = by_user.withColumn("month_number", _spine(months)).select(
        "user_id",
        "month_number",
        month_name(month).alias("month_name"),
        *[money(sums[t]).alias(f"{t}_amount") for t in TRANSACTION_TYPES],
        *[money(F.col(f"{t}_year_total")).alias(f"{t}_year_total") for t in TRANSACTION_TYPES],
    )
    return rows.select(
        "*",
        *[
            money(F.sum(f"{t}_amount").over(so_far)).alias(f"{t}_running_total")
            for t in TRANSACTION_TYPES
        ],
    )


def annual_report(
    ledger: Ledger, year: int, as_of: date, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Months so far with amounts, running totals and full-year totals.

    Every profile gets its months, active or not.
    """
    users = _of_user(ledger.profiles, user_id, "id").select(F.col("id").alias("user_id"))
    by_user = users.join(_year_by_user(ledger, year, user_id), "user_id", "left")
    kinds = ("income", "expense", "investment")
    report = _with_running_totals(by_user, months_shown(year, as_of)).select(
        "user_id",
        "month_number",
        "month_name",
        *[f"{t}_amount" for t in kinds],
        *[F.col(f"{t}_running_total").alias(f"running_{t}_total") for t in kinds],
        *[F.col(f"{t}_year_total").alias(f"year_to_date_{t}_total") for t in kinds],
    )
    return _arranged(report, user_id, ordered, "month_number")


def annual_trend(
    ledger: Ledger, year: int, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """All 12 months of users active in the year, columns grouped by type."""
    columns = [
        f"{t}_{what}"
        for t in ("income", "expense", "investment")
        for what in ("amount", "running_total", "year_total")
    ]
    report = _with_running_totals(_year_by_user(ledger, year, user_id), 12).select(
        "user_id", F.lit(year).alias("year_number"), "month_number", "month_name", *columns
    )
    return _arranged(report, user_id, ordered, "month_number")


def annual_categories(
    ledger: Ledger, year: int, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Every category's total in the year and share of its type."""
    rows = activity(ledger, year_period(year), user_id)
    return _all_category_shares(ledger, rows, user_id, ordered)


def all_time_categories(
    ledger: Ledger, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Every category's total and share of its type over all time."""
    return _all_category_shares(ledger, activity(ledger, None, user_id), user_id, ordered)


def _all_category_shares(
    ledger: Ledger, rows: DataFrame, user_id: object | None, ordered: bool
) -> DataFrame:
    own = _of_user(ledger.categories, user_id).select(
        "user_id",
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("icon").alias("category_icon"),
        F.col("color").alias("category_color"),
        F.col("type").alias("category_type"),
    )
    per_category = own.join(by_category(rows), ["user_id", "category_id"], "left").withColumn(
        "amount", money(F.col("amount"))
    )
    bases = _bases_by_category_type(per_category)
    report = attach_totals(per_category, bases, "user_id").select(
        "user_id",
        "category_name",
        "category_icon",
        "category_color",
        F.col("amount").alias("total_amount"),
        # Unlike a month's shares, a negative base counts; only a zero base gives 0.
        F.coalesce(percent(F.col("amount"), _base_of_row()), F.lit(0))
        .cast(PERCENT)
        .alias("percentage"),
        F.col("category_type").alias("transaction_type"),
    )
    return _arranged(report, user_id, ordered, "transaction_type", F.desc("total_amount"))


# --- all time --------------------------------------------------------------


def _year_and_month() -> list[Column]:
    return [F.year("date").alias("year"), F.month("date").alias("month")]


def all_time_balance(
    ledger: Ledger, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Each active month's sums and the balance carried up to it."""
    monthly = totals_by(activity(ledger, None, user_id), "user_id", *_year_and_month())
    # The window has the months by user already; a merge shuffles the profiles alone, which
    # by their compressed size would be broadcast however many they are.
    opening = _of_user(ledger.profiles, user_id, "id").select(
        F.col("id").alias("user_id"), money(F.col("initial_balance")).alias("initial_balance")
    ).hint("merge")
    so_far = (
        Window.partitionBy("user_id")
        .orderBy("year", "month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    report = (
        monthly.withColumn("net_amount", net_of_all())
        .withColumn("net_so_far", F.sum("net_amount").over(so_far))
        .join(opening, "user_id", "left")
        .select(
            "user_id",
            "year",
            "month",
            month_name(F.col("month")).alias("month_name"),
            F.col("income").alias("income_amount"),
            F.col("expense").alias("expense_amount"),
            F.col("investment").alias("investment_amount"),
            "net_amount",
            "initial_balance",
            (F.col("initial_balance") + F.col("net_so_far")).cast(MONEY).alias("cumulative_balance"),
        )
    )
    return _arranged(report, user_id, ordered, "year", "month")


def yearly_trends(
    ledger: Ledger, kind: str | None = None, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Amount, count and average per month, optionally of one type."""
    rows = activity(ledger, None, user_id)
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    amount, count = total(F.col("amount")), F.sum("n")
    report = rows.groupBy("user_id", *_year_and_month()).agg(
        amount.alias("total_amount"),
        count.alias("transaction_count"),
        F.round(amount / count, 2).cast(MONEY).alias("average_amount"),
    )
    return _arranged(report, user_id, ordered, "year", "month")


def all_time_totals(
    ledger: Ledger, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """D3: all-time sums, net worth and savings rate of every profile."""
    sums = totals_by(activity(ledger, None, user_id), "user_id")
    users = _of_user(ledger.profiles, user_id, "id").select(
        F.col("id").alias("user_id"), money(F.col("initial_balance")).alias("opening")
    )
    saved = F.col("total_income") - F.col("total_expense")
    report = (
        users.join(sums, "user_id", "left")
        .select(
            "user_id",
            "opening",
            money(F.col("income")).alias("total_income"),
            money(F.col("expense")).alias("total_expense"),
            money(F.col("investment")).alias("total_investments"),
        )
        .select(
            "user_id",
            "total_income",
            "total_expense",
            "total_investments",
            (F.col("opening") + saved).cast(MONEY).alias("net_worth"),
            percent(saved, F.col("total_income")).alias("savings_rate"),
        )
    )
    return _arranged(report, user_id, ordered)


def recent_years_summary(
    ledger: Ledger, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """Income, expense and their difference in the 5 latest active years.

    Investments make a year active but do not enter its net amount.
    """
    yearly = totals_by(activity(ledger, None, user_id), "user_id", F.year("date").alias("year"))
    users = ledger.profiles.select(F.col("id").alias("user_id"))
    report = (
        latest(yearly, F.desc("year"))
        .join(users, "user_id", "left_semi")
        .select(
            "user_id",
            "year",
            F.col("income").alias("total_income"),
            F.col("expense").alias("total_expense"),
            (F.col("income") - F.col("expense")).cast(MONEY).alias("net_amount"),
        )
    )
    return _arranged(report, user_id, ordered, F.desc("year"))


def top_categories_all_time(
    ledger: Ledger, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """The 5 largest categories of all time and the rest as 'Others'.

    Profiles without categorised rows get one 'Others' row with no percentage.
    """
    per_category = by_category(activity(ledger, None, user_id))
    groups = named_groups(per_category, ledger.categories, ["user_id"])
    ranked = top_with_others(groups, ["user_id"], OTHERS_ICON_ALL_TIME)
    users = _of_user(ledger.profiles, user_id, "id").select(F.col("id").alias("user_id"))
    empty = F.array(others_entry(F.lit(None), OTHERS_ICON_ALL_TIME))
    report = (
        users.join(ranked, "user_id", "full_outer")
        .select("user_id", F.inline(F.coalesce("entries", empty)))
        .select("user_id", "category", "percentage", "icon", "color", "is_others")
    )
    return _arranged(report, user_id, ordered, "is_others", F.desc_nulls_last("percentage"))


def top_categories_recent_years(
    ledger: Ledger, user_id: object | None = None, ordered: bool = False
) -> DataFrame:
    """For each of the 5 latest active years, an array of the top categories.

    A year without categorised rows has an empty array.
    """
    year = F.year("date").alias("year")
    # One pass: uncategorised rows stay as a group of their own, as they make a year active.
    amounts = activity(ledger, None, user_id).groupBy("user_id", "category_id", year).agg(
        total(F.col("amount")).alias("amount")
    )
    report = top_by_year(amounts, ledger.categories, OTHERS_ICON_BY_YEAR)
    return _arranged(report, user_id, ordered, F.desc("year"))
