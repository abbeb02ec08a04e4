"""The reports as table functions of Spark SQL.

``register_reports(ledger)`` makes the ledger's tables views and each report a function
that returns a table, for one user:

    SELECT * FROM monthly_report('u-17', 1998, 3);
    SELECT p.id AS user_id, r.* FROM profiles p, LATERAL monthly_report(p.id, 1998, 3) r;

Called with constants, user and period reach the scan as pushed filters.  In LATERAL
Spark turns the function's body into joins and groupings by user, so many users are one
distributed pass.  Columns and rows are those of ``operators.reports`` without user_id.

The bodies join outwards only from what is filtered by the user, as Spark can't take
the user out of the inner side of an outer join; spines come from arrays instead.
"""

from __future__ import annotations

from ledgerloom.model import Ledger
from ledgerloom.plans.ranking import OTHERS_COLOR, OTHERS_ICON_ALL_TIME, OTHERS_ICON_BY_YEAR, OTHERS_NAME, TOP

_KINDS = ("income", "expense", "investment")
_MONEY = "DECIMAL(18,2)"


def _money(expression: str) -> str:
    return f"CAST(coalesce({expression}, 0) AS {_MONEY})"


def _of_type(kind: str, by: str = "type", amount: str = "amount") -> str:
    return f"sum(CASE WHEN {by} = '{kind}' THEN {amount} END)"


def _percent(part: str, whole: str) -> str:
    """Half up to two places, in whole hundredths; NULL for a zero whole."""
    a, b = (f"CAST(({x}) * 100 AS DECIMAL(20,0))" for x in (part, whole))
    hundredths = f"(abs({a}) * 20000 + abs({b})) DIV nullif(CAST(2 * abs({b}) AS DECIMAL(38,0)), 0)"
    signed = f"CASE WHEN ({a} < 0) <> ({b} < 0) THEN -({hundredths}) ELSE {hundredths} END"
    return f"CAST(CAST({signed} AS DECIMAL(18,0)) * 0.01BD AS {_MONEY})"


def _mine(*columns: str, where: str = "true") -> str:
    return f"(SELECT {', '.join(columns)} FROM {{transactions}} WHERE user_id = the_user AND {where})"


# The ranges reach the scan; the equalities give LATERAL's joins something to hash by.
_IN_MONTH = (
    "year(date) = the_year AND month(date) = the_month"
    " AND date >= make_date(the_year, the_month, 1) AND date < add_months(make_date(the_year, the_month, 1), 1)"
)
_IN_YEAR = "year(date) = the_year AND date >= make_date(the_year, 1, 1) AND date < make_date(the_year + 1, 1, 1)"
_SHOWN = "CASE WHEN the_year < year(as_of) THEN 12 ELSE month(as_of) END"
_MONTH_NAME = "date_format(make_date(2000, {}, 1), 'MMMM')"
_LABELS = "category_name STRING, category_icon STRING, category_color STRING"


def _calendar() -> str:
    totals = ", ".join(f"{_of_type(k)} OVER () AS all_{k}" for k in _KINDS)
    sums = [_money(f"all_{k}") for k in _KINDS]
    return f"""
SELECT t.id, t.date, c.id, c.name, c.icon, c.color, CAST(t.amount AS {_MONEY}), t.type, t.note,
       {', '.join(sums)}, CAST({' - '.join(sums)} AS {_MONEY})
FROM {_mine('*', totals, where=_IN_MONTH)} t JOIN {{categories}} c ON c.id = t.category_id"""


def _monthly_report() -> str:
    kinds = ", ".join(f"{_of_type(k, 't.type')} AS {k}" for k in _KINDS)
    totals = ", ".join(f"sum({k}) OVER () AS all_{k}" for k in _KINDS)
    sums = [_money(f"all_{k}") for k in _KINDS]
    return f"""
SELECT {', '.join(sums)}, CAST({' - '.join(sums)} AS {_MONEY}), label.name, label.icon, label.color, label.type,
       CAST(amount AS {_MONEY}), CASE WHEN base > 0 THEN {_percent('amount', 'base')} ELSE CAST(0 AS {_MONEY}) END
FROM (
  SELECT *, {totals}, sum(amount) OVER (PARTITION BY label.type) AS base
  FROM (
    SELECT label, sum(t.amount) AS amount, {kinds}
    FROM ({_mine('user_id', 'category_id', 'amount', 'type', where=_IN_MONTH)[1:-1]}
          UNION ALL {_marker(4)}) t
    LEFT JOIN (SELECT id, user_id, struct(id, name, icon, color, type) AS label FROM {{categories}}) c
      ON c.id = t.category_id AND c.user_id = t.user_id
    GROUP BY label
  )
)
WHERE amount > 0 AND label IS NOT NULL"""


def _category_trend() -> str:
    monthly = _mine("month(date) AS m", "amount", "date", where=f"category_id = the_category AND {_IN_YEAR}")
    return f"""
SELECT m, {_MONTH_NAME.format('m')}, {_money('try_element_at(by_month, m)')}, label.name, label.icon, label.color, label.type,
       CASE WHEN month(latest) = m THEN date_format(latest, 'dd.MM yyyy (EEE)') ELSE '' END, latest
FROM (
  SELECT max(label) AS label, map_from_entries(collect_list(CASE WHEN m IS NOT NULL THEN struct(m, a) END)) AS by_month,
         max(d) AS latest
  FROM (
    SELECT struct(name, icon, color, type) AS label, CAST(NULL AS INT) AS m, CAST(NULL AS DECIMAL(22,2)) AS a, CAST(NULL AS DATE) AS d
    FROM {{categories}} WHERE user_id = the_user AND id = the_category
    UNION ALL
    SELECT NULL, m, sum(amount), max(date) FROM {monthly} GROUP BY m
  )
  HAVING max(label) IS NOT NULL
) LATERAL VIEW explode(sequence(1, 12)) AS m
WHERE m <= {_SHOWN}"""


def _marker(columns: int) -> str:
    """A row of NULLs for the user's profile.

    With it Spark carries user and period through the body together; alone, a constant
    period would come as a nested loop with one row.
    """
    return f"SELECT {', '.join(['NULL'] * columns)} FROM {{profiles}} WHERE id = the_user"


def _by_month(having: str) -> str:
    """One row: a map of months to sums, the year and its sums."""
    sums = ", ".join(f"{_of_type(k)} AS {k}" for k in _KINDS)
    full = ", ".join(f"sum({k}) AS {k}" for k in _KINDS)
    months = _mine("month(date) AS m", "year(date) AS y", "type", "amount", where=_IN_YEAR)
    entry = f"struct(m, struct({', '.join(_KINDS)}))"
    return f"""(
  SELECT map_from_entries(collect_list(CASE WHEN m IS NOT NULL THEN {entry} END)) AS by_month, max(y) AS y, {full}
  FROM (
    SELECT m, y, {sums} FROM {months} GROUP BY m, y
    UNION ALL {_marker(2 + len(_KINDS))}
  )
  HAVING {having}
)"""


def _amount(kind: str) -> str:
    return _money(f"try_element_at(by_month, m).{kind}")


def _running(kind: str) -> str:
    return f"CAST(sum({_amount(kind)}) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS {_MONEY})"


def _annual_report() -> str:
    columns = [f(k) for f in (_amount, _running, _money) for k in _KINDS]
    return f"""
SELECT m, {_MONTH_NAME.format('m')}, {', '.join(columns)}
FROM {_by_month('count(*) > count(m)')} LATERAL VIEW explode(sequence(1, 12)) AS m
WHERE m <= {_SHOWN}"""


def _annual_trend() -> str:
    columns = [f(k) for k in _KINDS for f in (_amount, _running, _money)]
    return f"""
SELECT y, m, {_MONTH_NAME.format('m')}, {', '.join(columns)}
FROM {_by_month('count(m) > 0')} LATERAL VIEW explode(sequence(1, 12)) AS m"""


def _category_shares(where: str) -> str:
    return f"""
SELECT label.name, label.icon, label.color, CAST(amount AS {_MONEY}),
       coalesce({_percent('amount', 'base')}, CAST(0 AS {_MONEY})), label.type
FROM (
  SELECT label, amount, sum(amount) OVER (PARTITION BY label.type) AS base
  FROM (
    SELECT category_id, max(label) AS label, sum(amount) AS amount
    FROM (
      SELECT id AS category_id, struct(name, icon, color, type) AS label, CAST(0 AS DECIMAL(12,2)) AS amount
      FROM {{categories}} WHERE user_id = the_user
      UNION ALL
      SELECT category_id, NULL, amount FROM {_mine('category_id', 'amount', where=f'category_id IS NOT NULL AND {where}')}
    )
    GROUP BY category_id HAVING max(label) IS NOT NULL
  )
)"""


def _all_time_balance() -> str:
    sums = ", ".join(f"{_money(_of_type(k))} AS {k}" for k in _KINDS)
    net = f"CAST({' - '.join(_KINDS)} AS {_MONEY})"
    return f"""
SELECT y, m, {_MONTH_NAME.format('m')}, {', '.join(_KINDS)}, {net}, CASE WHEN p.id IS NOT NULL THEN {_money('p.initial_balance')} END,
       CAST(CASE WHEN p.id IS NOT NULL THEN {_money('p.initial_balance')} END + so_far AS {_MONEY})
FROM (
  SELECT *, sum({net}) OVER (ORDER BY y, m ROWS UNBOUNDED PRECEDING) AS so_far
  FROM (
    SELECT user_id, y, m, {sums}
    FROM {_mine('user_id', 'year(date) AS y', 'month(date) AS m', 'type', 'amount')} GROUP BY user_id, y, m
  )
) t LEFT JOIN {{profiles}} p ON p.id = t.user_id"""


def _entry(name: str, pct: str, icon: str, color: str, others: int) -> str:
    return (
        f"named_struct('category', {name}, 'percentage', CAST({pct} AS {_MONEY}), 'icon', {icon},"
        f" 'color', {color}, 'is_others', {others})"
    )


def _top(ranked: str, icon: str, keys: str = "") -> str:
    """Per key one row: the top groups in order, with what they leave of 100 %."""
    pct = f"CASE WHEN label IS NOT NULL THEN {_percent('amount', 'grand')} END"
    listed = f"transform(top, g -> {_entry('g.label.name', 'g.pct', 'g.label.icon', 'g.label.color', 0)})"
    rest = f"array({_entry(repr(OTHERS_NAME), '100 - covered', repr(icon), repr(OTHERS_COLOR), 1)})"
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}top, {listed} AS listed, {rest} AS rest
FROM (
  SELECT {lead}sort_array(collect_list(CASE WHEN label IS NOT NULL THEN struct(-pct AS first, rk, pct, label) END)) AS top, sum(pct) AS covered
  FROM (SELECT *, {pct} AS pct FROM ({ranked}) WHERE label IS NULL OR rk <= {TOP})
  {group}
)"""


def _top_all_time() -> str:
    ranked = f"""
SELECT label, amount, row_number() OVER (ORDER BY amount DESC, label) AS rk, sum(amount) OVER () AS grand
FROM (
  SELECT struct(c.name, c.icon, c.color) AS label, CAST(sum(t.amount) AS {_MONEY}) AS amount
  FROM {_mine('category_id', 'amount')} t JOIN {{categories}} c ON c.id = t.category_id
  GROUP BY struct(c.name, c.icon, c.color)
)"""
    return f"""
SELECT e.category, e.percentage, e.icon, e.color, e.is_others
FROM (SELECT explode(concat(listed, rest)) AS e FROM ({_top(ranked, OTHERS_ICON_ALL_TIME)}))"""


def _recent_years() -> str:
    return f"""
SELECT y, {_money(_of_type('income'))}, {_money(_of_type('expense'))},
       CAST({_money(_of_type('income'))} - {_money(_of_type('expense'))} AS {_MONEY})
FROM {_mine('user_id', 'year(date) AS y', 'type', 'amount')} t JOIN {{profiles}} p ON p.id = t.user_id
GROUP BY y ORDER BY y DESC LIMIT {TOP}"""


def _top_recent_years() -> str:
    ranked = f"""
SELECT y, label, amount, row_number() OVER (PARTITION BY y ORDER BY label IS NULL, amount DESC, label) AS rk,
       sum(CASE WHEN label IS NOT NULL THEN amount END) OVER (PARTITION BY y) AS grand
FROM (
  SELECT y, label, CAST(sum(amount) AS {_MONEY}) AS amount
  FROM (
    SELECT y, CASE WHEN c.id IS NOT NULL THEN struct(c.name, c.icon, c.color) END AS label, amount
    FROM (SELECT *, dense_rank() OVER (ORDER BY y DESC) AS back FROM {_mine('category_id', 'year(date) AS y', 'amount')}) t
    LEFT JOIN {{categories}} c ON c.id = t.category_id
    WHERE back <= {TOP}
  )
  GROUP BY y, label
)"""
    return f"""
SELECT y, CASE WHEN size(top) > 0 THEN concat(listed, rest) ELSE slice(rest, 1, 0) END
FROM ({_top(ranked, OTHERS_ICON_BY_YEAR, 'y')})"""


def _columns(*names: str) -> str:
    return ", ".join(f"{n} {_MONEY}" for n in names)


_SHARES = f"{_LABELS}, total_amount {_MONEY}, percentage {_MONEY}, transaction_type STRING"
_TRIPLES = _columns(*(f"{k}_{w}" for k in _KINDS for w in ("amount", "running_total", "year_total")))
_ENTRY_TYPE = f"STRUCT<category: STRING, percentage: {_MONEY}, icon: STRING, color: STRING, is_others: INT>"

# Name: parameters after the user, columns, body.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "monthly_calendar": (
        "the_year INT, the_month INT",
        f"transaction_id {{id}}, transaction_date DATE, category_id {{id}}, {_LABELS}, amount {_MONEY}, transaction_type STRING,"
        " note STRING, " + _columns("month_total_income", "month_total_expense", "month_total_investment", "month_net_balance"),
        _calendar(),
    ),
    "monthly_report": (
        "the_year INT, the_month INT",
        _columns("total_income", "total_expense", "total_investment", "net_balance")
        + f", {_LABELS}, category_type STRING, " + _columns("category_amount", "category_percentage"),
        _monthly_report(),
    ),
    "category_trend": (
        "the_year INT, as_of DATE, the_category {id}",
        f"month INT, month_name STRING, amount {_MONEY}, {_LABELS}, category_type STRING, date_label STRING,"
        " latest_transaction_date DATE",
        _category_trend(),
    ),
    "annual_report": (
        "the_year INT, as_of DATE",
        "month_number INT, month_name STRING, "
        + _columns(*(f"{k}_amount" for k in _KINDS), *(f"running_{k}_total" for k in _KINDS), *(f"year_to_date_{k}_total" for k in _KINDS)),
        _annual_report(),
    ),
    "annual_trend": ("the_year INT", f"year_number INT, month_number INT, month_name STRING, {_TRIPLES}", _annual_trend()),
    "annual_categories": ("the_year INT", _SHARES, _category_shares(_IN_YEAR)),
    "all_time_balance": (
        "",
        "year INT, month INT, month_name STRING, "
        + _columns(*(f"{k}_amount" for k in _KINDS), "net_amount", "initial_balance", "cumulative_balance"),
        _all_time_balance(),
    ),
    "all_time_categories": ("", _SHARES, _category_shares("true")),
    "top_categories_all_time": (
        "", f"category STRING, percentage {_MONEY}, icon STRING, color STRING, is_others INT", _top_all_time()
    ),
    "recent_years_summary": ("", "year INT, " + _columns("total_income", "total_expense", "net_amount"), _recent_years()),
    "top_categories_recent_years": ("", f"year INT, categories ARRAY<{_ENTRY_TYPE}>", _top_recent_years()),
}


def register_reports(ledger: Ledger, prefix: str = "") -> None:
    """Makes the ledger's tables views and its reports functions, all named with ``prefix``.

    Functions are temporary: they last as long as the session and are replaced when
    registered again.
    """
    ledger.create_views(prefix)
    spark = ledger.profiles.sparkSession
    id_type = ledger.profiles.schema["id"].dataType.simpleString()
    views = {name: prefix + name for name in ledger.tables()}
    for name, (parameters, columns, body) in FUNCTIONS.items():
        given = ", ".join(p for p in ("the_user {id}", parameters) if p).replace("{id}", id_type)
        text = body
        for table, view in views.items():
            text = text.replace(f"{{{table}}}", view)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given})"
            f" RETURNS TABLE ({columns.replace('{id}', id_type)}) RETURN {text}"
        )
