"""The queries of ``ledgerloom.catalog`` in plain SQL over the provided tables.

Written for DuckDB and independently of the Spark plans: running totals and
shares as windows, schedules as a recursive query, rules as CASE chains.
"""

from __future__ import annotations

# Fixed values, kept apart from the engine's own copy: what every new user starts with.
DEFAULT_CATEGORIES = (
    ("Food", "expense", "fastfood", "#FF5252"),
    ("Transportation", "expense", "directions-car", "#448AFF"),
    ("Houseware", "expense", "home-work", "#9C27B0"),
    ("Bills", "expense", "payments", "#FF9800"),
    ("Shopping", "expense", "shopping-bag", "#E91E63"),
    ("Salary", "income", "currency-exchange", "#4CAF50"),
    ("Freelance", "income", "work", "#8BC34A"),
    ("Bonus", "income", "money", "#CDDC39"),
    ("Stocks", "investment", "inventory", "#795548"),
    ("Real Estate", "investment", "domain", "#607D8B"),
    ("Crypto", "investment", "currency-bitcoin", "#9E9E9E"),
)

AS_OF = "DATE '2001-08-01'"
YEAR, MONTH, DAY = 1998, 3, "DATE '1998-03-15'"

# --- the ledger (FIXTURES.md section 2) ------------------------------------

PROFILES = """
profiles AS (
  SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS email, 'USD' AS currency,
         CAST(c_acctbal AS DECIMAL(12,2)) AS initial_balance
  FROM customer)"""

CATEGORIES = """
categories AS (
  SELECT c_custkey * 100 + t * 10 + p AS id, c_custkey AS user_id,
         CASE WHEN p = 5 THEN 'Misc' ELSE kind || ' ' || p END AS name,
         kind AS type,
         CASE WHEN p = 5 THEN 'more' ELSE 'icon-' || t || p END AS icon,
         CASE WHEN p = 5 THEN '#808080' ELSE '#' || t || p || '0000' END AS color,
         p <= 2 AS is_default
  FROM customer,
       (VALUES (1, 'income'), (2, 'expense'), (3, 'investment')) AS k(t, kind),
       (VALUES (1), (2), (3), (4), (5)) AS n(p))"""

TRANSACTIONS = """
typed_orders AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS t FROM orders),
transactions AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE WHEN o_orderkey % 20 <> 0 THEN
           o_custkey * 100
           + ((t - 1 + CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END) % 3 + 1) * 10
           + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS category_id,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         CAST(NULL AS VARCHAR) AS note,
         CAST(o_orderdate AS DATE) AS date,
         CASE t WHEN 1 THEN 'income' WHEN 2 THEN 'expense' ELSE 'investment' END AS type,
         o_orderdate AS created_at
  FROM typed_orders)"""

GOALS = """
financial_goals AS (
  SELECT c_custkey AS id, c_custkey AS user_id, c_name AS name,
         CAST(10000.00 AS DECIMAL(12,2)) AS target_amount,
         CAST(greatest(CAST(c_acctbal AS DECIMAL(12,2)), 0) AS DECIMAL(12,2)) AS current_amount,
         CASE WHEN c_custkey % 10 <> 3
           THEN DATE '2001-01-01' + CAST(c_custkey % 730 AS INTEGER) END AS deadline,
         CASE c_custkey % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'completed' ELSE 'cancelled' END
           AS status
  FROM customer)"""

SCHEDULES = """
schedules AS (
  SELECT p_partkey AS id,
         CASE (p_partkey // 5) % 3 WHEN 0 THEN 'fixed_costs' WHEN 1 THEN 'periodic_income'
           ELSE 'fixed_investments' END AS schedule,
         p_partkey % 150 AS user_id,
         (p_partkey % 150) * 100
           + CASE (p_partkey // 5) % 3 WHEN 0 THEN 21 WHEN 1 THEN 11 ELSE 31 END AS category_id,
         CAST(p_retailprice AS DECIMAL(12,2)) AS amount,
         CASE p_partkey % 6 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'biweekly'
           WHEN 3 THEN 'monthly' WHEN 4 THEN 'quarterly' ELSE 'annually' END AS frequency,
         DATE '1999-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS start_date,
         CASE (p_partkey // 6) % 3
           WHEN 1 THEN DATE '1999-01-01' + CAST(p_partkey % 1000 AS INTEGER) + 730
           WHEN 2 THEN DATE '2001-12-31' END AS end_date,
         CAST(NULL AS VARCHAR) AS note,
         CASE (p_partkey // 18) % 10 WHEN 9 THEN NULL WHEN 8 THEN false ELSE true END AS is_active,
         CAST(NULL AS TIMESTAMP) AS created_at,
         CASE WHEN (p_partkey // 7) % 4 = 0 THEN DATE '2001-05-31' END AS last_generated_date,
         CASE WHEN (p_partkey // 5) % 3 = 2 AND (p_partkey // 10) % 4 <> 0
           THEN CAST((p_partkey % 2000) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)) END
           AS expected_return_rate,
         CASE WHEN (p_partkey // 5) % 3 = 2 THEN p_type END AS investment_type
  FROM part)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE" if recursive else "WITH") + ",".join(parts)


def _money(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(18,2))"


def _sum_of(kind: str, source: str = "type", amount: str = "amount") -> str:
    return _money(f"coalesce(sum(CASE WHEN {source} = '{kind}' THEN {amount} END), 0)")


def _pct(part: str, whole: str) -> str:
    """Exact percentage, half away from zero; NULL for a zero whole."""
    a, g = f"CAST(({part}) * 100 AS HUGEINT)", f"CAST(({whole}) * 100 AS HUGEINT)"
    hundredths = f"(20000 * abs({a}) + abs({g})) // (2 * abs({g}))"
    signed = f"sign({a}) * sign({g}) * ({hundredths})"
    return (
        f"CASE WHEN {g} <> 0 THEN CAST(CAST({signed} AS DECIMAL(16,0))"
        f" * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END"
    )


def _share(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN {_pct(part, whole)} ELSE 0 END AS DECIMAL(18,2))"


IN_YEAR = "year(date) = {}"
IN_MONTH = f"year(date) = {YEAR} AND month(date) = {MONTH}"
MONTHS = "(SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS m)"
YM = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month"
KINDS = ("income", "expense", "investment")


def _month_name(month: str) -> str:
    return f"strftime(make_date(2000, {month}, 1), '%B')"


def _shown(year: int) -> str:
    return f"(m <= month({AS_OF}) OR {year} < year({AS_OF}))"


# --- reports ---------------------------------------------------------------

MONTH_TOTALS = f"""
month_totals AS (
  SELECT user_id, {", ".join(f"{_sum_of(k)} AS {k}" for k in KINDS)}
  FROM transactions WHERE {IN_MONTH} GROUP BY user_id)"""

MONTH_SHARES = f"""
own_rows AS (
  SELECT c.user_id, c.id AS category_id, c.name AS category_name, c.icon AS category_icon,
         c.color AS category_color, c.type AS category_type, t.amount AS part
  FROM transactions t
  JOIN categories c ON c.id = t.category_id AND c.user_id = t.user_id WHERE {IN_MONTH}),
summed AS (SELECT * EXCLUDE (part), {_money("sum(part)")} AS amount FROM own_rows GROUP BY ALL),
per_category AS (
  SELECT *, sum(amount) OVER (PARTITION BY user_id, category_type) AS base FROM summed)"""


def _calendar() -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS, MONTH_TOTALS)}
SELECT t.user_id, t.id AS transaction_id, t.date AS transaction_date, c.id AS category_id,
       c.name AS category_name, c.icon AS category_icon, c.color AS category_color,
       {_money("t.amount")} AS amount, t.type AS transaction_type, t.note,
       income AS month_total_income, expense AS month_total_expense,
       investment AS month_total_investment,
       {_money("income - expense - investment")} AS month_net_balance
FROM transactions t JOIN categories c ON t.category_id = c.id JOIN month_totals m
  ON m.user_id = t.user_id
WHERE {IN_MONTH}"""


def _monthly_report() -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS, MONTH_TOTALS, MONTH_SHARES)}
SELECT p.user_id, income AS total_income, expense AS total_expense,
       investment AS total_investment, {_money("income - expense - investment")} AS net_balance,
       category_name, category_icon, category_color, category_type, amount AS category_amount,
       {_share("amount", "base")} AS category_percentage
FROM per_category p JOIN month_totals m ON m.user_id = p.user_id WHERE amount > 0"""


def _category_breakdown() -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS, MONTH_SHARES)}
SELECT user_id, category_id, category_name, amount AS total_amount,
       {_share("amount", "base")} AS percentage
FROM per_category WHERE amount > 0"""


def _monthly_summary() -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS, MONTH_TOTALS, MONTH_SHARES)}
SELECT m.user_id, income AS total_income, expense AS total_expense,
       {_money("income - expense")} AS net_savings, p.category_id, p.category_name, p.amount AS total_amount
FROM month_totals m
LEFT JOIN (SELECT * FROM per_category WHERE amount > 0) p ON p.user_id = m.user_id"""


def _category_trend(year: int) -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS)},
of_year AS (SELECT * FROM transactions WHERE {IN_YEAR.format(year)}),
latest AS (SELECT user_id, category_id, max(date) AS d FROM of_year GROUP BY ALL),
sums AS (SELECT user_id, category_id, month(date) AS m, sum(amount) AS amount
         FROM of_year GROUP BY ALL)
SELECT c.user_id, c.id AS category_id, s.m AS month, {_month_name("s.m")} AS month_name,
       {_money("coalesce(x.amount, 0)")} AS amount, c.name AS category_name,
       c.icon AS category_icon, c.color AS category_color, c.type AS category_type,
       CASE WHEN month(l.d) = s.m THEN strftime(l.d, '%d.%m %Y (%a)') ELSE '' END AS date_label,
       l.d AS latest_transaction_date
FROM categories c CROSS JOIN {MONTHS} s
LEFT JOIN latest l ON l.category_id = c.id AND l.user_id = c.user_id
LEFT JOIN sums x ON x.category_id = c.id AND x.user_id = c.user_id AND x.m = s.m
WHERE {_shown(year).replace("m <=", "s.m <=")}"""


def _year_parts(year: int) -> str:
    sums = ", ".join(f"{_sum_of(k)} AS {k}" for k in KINDS)
    return f"""
monthly AS (SELECT user_id, month(date) AS m, {sums}
            FROM transactions WHERE {IN_YEAR.format(year)} GROUP BY ALL),
yearly AS (SELECT user_id, {sums} FROM transactions WHERE {IN_YEAR.format(year)} GROUP BY ALL)"""


def _running(kind: str) -> str:
    return _money(
        f"sum(coalesce(x.{kind}, 0)) OVER (PARTITION BY u.user_id ORDER BY s.m"
        " ROWS UNBOUNDED PRECEDING)"
    )


def _annual_report(year: int, changed: str = "transactions") -> str:
    """``changed``: what to report on in place of the transactions."""
    amounts = ", ".join(f"{_money(f'coalesce(x.{k}, 0)')} AS {k}_amount" for k in KINDS)
    running = ", ".join(f"{_running(k)} AS running_{k}_total" for k in KINDS)
    full = ", ".join(
        f"{_money(f'coalesce(y.{k}, 0)')} AS year_to_date_{k}_total" for k in KINDS
    )
    parts = _year_parts(year).replace("FROM transactions", f"FROM {changed}")
    return f"""{_with(PROFILES, TRANSACTIONS, parts)}
SELECT u.user_id, s.m AS month_number, {_month_name("s.m")} AS month_name,
       {amounts}, {running}, {full}
FROM (SELECT id AS user_id FROM profiles) u CROSS JOIN {MONTHS} s
LEFT JOIN monthly x ON x.user_id = u.user_id AND x.m = s.m
LEFT JOIN yearly y ON y.user_id = u.user_id
WHERE {_shown(year).replace("m <=", "s.m <=")}"""


def _annual_trend(year: int) -> str:
    columns = ", ".join(
        f"{_money(f'coalesce(x.{k}, 0)')} AS {k}_amount, {_running(k)} AS {k}_running_total,"
        f" u.{k} AS {k}_year_total"
        for k in KINDS
    )
    return f"""{_with(TRANSACTIONS, _year_parts(year))}
SELECT u.user_id, {year} AS year_number, s.m AS month_number, {_month_name("s.m")} AS month_name,
       {columns}
FROM yearly u CROSS JOIN {MONTHS} s
LEFT JOIN monthly x ON x.user_id = u.user_id AND x.m = s.m"""


def _category_shares(period: str) -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS)},
spent AS (SELECT user_id, category_id, sum(amount) AS amount
          FROM transactions WHERE {period} GROUP BY ALL),
all_categories AS (
  SELECT c.*, {_money("coalesce(s.amount, 0)")} AS total_amount
  FROM categories c LEFT JOIN spent s ON s.category_id = c.id AND s.user_id = c.user_id),
based AS (SELECT *, sum(total_amount) OVER (PARTITION BY user_id, type) AS base
          FROM all_categories)
SELECT user_id, name AS category_name, icon AS category_icon, color AS category_color,
       total_amount, CAST(coalesce({_pct("total_amount", "base")}, 0) AS DECIMAL(18,2))
         AS percentage, type AS transaction_type
FROM based"""


def _all_time_balance() -> str:
    return f"""{_with(PROFILES, TRANSACTIONS)},
monthly AS (SELECT user_id, {YM}, {", ".join(f"{_sum_of(k)} AS {k}" for k in KINDS)}
            FROM transactions GROUP BY ALL)
SELECT t.user_id, year, month, {_month_name("month")} AS month_name, income AS income_amount,
       expense AS expense_amount, investment AS investment_amount,
       {_money("income - expense - investment")} AS net_amount,
       {_money("coalesce(p.initial_balance, 0)")} AS initial_balance,
       {_money('''coalesce(p.initial_balance, 0) + sum(income - expense - investment) OVER (
          PARTITION BY t.user_id ORDER BY year, month ROWS UNBOUNDED PRECEDING)''')}
         AS cumulative_balance
FROM monthly t LEFT JOIN profiles p ON p.id = t.user_id"""


def _top(keys: str, icon: str) -> str:
    """CTE ``entries``: top five and the rest per key."""
    return f"""
named AS (
  SELECT {keys}, c.name AS category, c.icon AS icon, c.color AS color, sum(t.amount) AS amount
  FROM dated t JOIN categories c ON c.id = t.category_id GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}
              ORDER BY amount DESC, category, icon, color) AS rk,
         sum(amount) OVER (PARTITION BY {keys}) AS grand
  FROM named),
top_five AS (
  SELECT {keys}, category, {_pct("amount", "grand")} AS percentage, icon, color, rk
  FROM ranked WHERE rk <= 5),
entries AS (
  SELECT {keys}, category, percentage, icon, color, 0 AS is_others, rk FROM top_five
  UNION ALL
  SELECT {keys}, 'Others', {_money("100 - sum(percentage)")}, '{icon}', '#808080', 1, 6
  FROM top_five GROUP BY {keys})"""


def _top_all_time() -> str:
    dated = "\ndated AS (SELECT user_id AS user_key, category_id, amount FROM transactions)"
    return f"""{_with(PROFILES, CATEGORIES, TRANSACTIONS, dated, _top("user_key", "more-horiz"))}
SELECT coalesce(p.id, e.user_key) AS user_id, coalesce(category, 'Others') AS category, percentage,
       coalesce(icon, 'more-horiz') AS icon, coalesce(color, '#808080') AS color,
       coalesce(is_others, 1) AS is_others
FROM profiles p FULL JOIN entries e ON e.user_key = p.id"""


def _top_recent_years() -> str:
    dated = """
dated AS (SELECT user_id AS user_key, category_id, amount, CAST(year(date) AS INTEGER) AS y
          FROM transactions)"""
    return f"""{_with(CATEGORIES, TRANSACTIONS, dated, _top("user_key, y", "ellipsis-h"))},
years AS (
  SELECT user_key, y FROM (SELECT DISTINCT user_key, y FROM dated)
  QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY y DESC) <= 5)
SELECT years.user_key AS user_id, years.y AS year,
       CASE WHEN category IS NOT NULL THEN CAST(row_number() OVER (
         PARTITION BY years.user_key, years.y ORDER BY is_others, percentage DESC, rk) - 1
         AS INTEGER) END AS position,
       category, percentage, icon, color, is_others
FROM years LEFT JOIN entries e ON e.user_key = years.user_key AND e.y = years.y"""


def _recent_years() -> str:
    return f"""{_with(PROFILES, TRANSACTIONS)}
SELECT user_id, CAST(year(date) AS INTEGER) AS year, {_sum_of("income")} AS total_income,
       {_sum_of("expense")} AS total_expense,
       {_money(_sum_of("income") + " - " + _sum_of("expense"))} AS net_amount
FROM transactions WHERE user_id IN (SELECT id FROM profiles) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(year(date) AS INTEGER) DESC) <= 5"""


def _yearly_trends(where: str = "true") -> str:
    cents = "CAST(sum(amount) * 100 AS HUGEINT)"
    average = f"CAST((2 * {cents} + count(*)) // (2 * count(*)) AS DECIMAL(16,0))"
    return f"""{_with(TRANSACTIONS)}
SELECT user_id, {YM}, {_money("sum(amount)")} AS total_amount, count(*) AS transaction_count,
       {_money(average + " * CAST(0.01 AS DECIMAL(3,2))")} AS average_amount
FROM transactions WHERE {where} GROUP BY ALL"""


def _all_time_totals() -> str:
    return f"""{_with(PROFILES, TRANSACTIONS)},
sums AS (
  SELECT p.id AS user_id, p.initial_balance,
         {", ".join(f"{_sum_of(k, 't.type', 't.amount')} AS {k}" for k in KINDS)}
  FROM profiles p LEFT JOIN transactions t ON t.user_id = p.id GROUP BY p.id, p.initial_balance)
SELECT user_id, income AS total_income, expense AS total_expense,
       investment AS total_investments,
       {_money("initial_balance + income - expense")} AS net_worth,
       {_pct("income - expense", "income")} AS savings_rate
FROM sums"""


# --- recurring schedules ---------------------------------------------------

NEXT = """CAST(CASE frequency
    WHEN 'daily' THEN d + INTERVAL 1 DAY WHEN 'weekly' THEN d + INTERVAL 7 DAY
    WHEN 'biweekly' THEN d + INTERVAL 14 DAY WHEN 'monthly' THEN d + INTERVAL 1 MONTH
    WHEN 'quarterly' THEN d + INTERVAL 3 MONTH WHEN 'annually' THEN d + INTERVAL 12 MONTH
  END AS DATE)"""
ELIGIBLE = f"(is_active IS TRUE AND (end_date IS NULL OR end_date >= {AS_OF}))"


def _expand(schedule: str | None, anchored: bool = False) -> str:
    only = "true" if schedule is None else f"schedule = '{schedule}'"
    first = "start_date" if anchored else "coalesce(last_generated_date, start_date)"
    wanted = "last_generated_date IS NULL OR d > last_generated_date" if anchored else "true"
    anchor = "" if anchored else ", first"
    walk = f"""
walk AS (
  SELECT *, {first} AS first, {first} AS d FROM schedules
  WHERE {ELIGIBLE} AND {only} AND {first} <= {AS_OF} AND (end_date IS NULL OR {first} <= end_date)
  UNION ALL
  SELECT * REPLACE ({NEXT} AS d) FROM walk
  WHERE {NEXT} <= {AS_OF} AND (end_date IS NULL OR {NEXT} <= end_date))"""
    return f"""{_with(SCHEDULES, walk, recursive=True)},
hashed AS (SELECT *, md5(concat_ws('|', schedule, id, d{anchor})) AS h FROM walk WHERE {wanted})
SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4),
                 substr(h, 21, 12)) AS id,
       id AS schedule_id, user_id, category_id,
       {_money('''CASE WHEN expected_return_rate IS NULL THEN amount ELSE
         CAST((CAST(amount * 100 AS HUGEINT) * CAST((100 + expected_return_rate) * 100 AS HUGEINT)
               + 5000) // 10000 AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) END''')} AS amount,
       CASE schedule WHEN 'fixed_costs' THEN 'Auto-generated fixed cost'
         WHEN 'periodic_income' THEN 'Auto-generated periodic income'
         ELSE 'Auto-generated investment: ' || investment_type END AS note,
       d AS date,
       CASE schedule WHEN 'fixed_costs' THEN 'expense' WHEN 'periodic_income' THEN 'income'
         ELSE 'investment' END AS type
FROM hashed"""


RUN_DAYS = ("2001-06-02", "2001-06-03", "2001-07-01", "2001-07-31", "2001-08-01")


def _run_due() -> str:
    """Every date after the mark is recorded by the first run on or after it, if the
    schedule has not ended by then."""
    days = ", ".join(f"(DATE '{d}')" for d in RUN_DAYS)
    first_run = f"(SELECT min(r) FROM (VALUES {days}) AS v(r) WHERE r >= d)"
    text = _expand(None, anchored=True).replace(f"WHERE {ELIGIBLE} AND", "WHERE is_active IS TRUE AND")
    text = text.replace("FROM walk WHERE last", f"FROM walk WHERE (end_date IS NULL OR end_date >= {first_run}) AND (last")
    text = text.replace("d > last_generated_date)\nSELECT", "d > last_generated_date))\nSELECT")
    return text.replace("id AS schedule_id, user_id, category_id", "CAST(id AS VARCHAR) AS schedule_id, CAST(user_id AS VARCHAR) AS user_id, CAST(category_id AS VARCHAR) AS category_id")


def _advance() -> str:
    return f"""{_with(SCHEDULES)}
SELECT schedule, id, user_id, category_id, amount, frequency, start_date, end_date, note, is_active,
       created_at, CASE WHEN {ELIGIBLE} THEN {AS_OF} ELSE last_generated_date END AS last_generated_date
FROM schedules"""


# --- listings --------------------------------------------------------------

EMBEDDED = """c.user_id AS category_user_id, c.name AS category_name, c.type AS category_type,
       c.icon AS category_icon, c.color AS category_color, c.is_default AS category_is_default"""


def _list_transactions(where: str = "true") -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS)}
SELECT t.*, {EMBEDDED} FROM transactions t LEFT JOIN categories c ON c.id = t.category_id
WHERE {where}"""


def _list_schedules() -> str:
    return f"""{_with(CATEGORIES, SCHEDULES)}
SELECT s.*, {EMBEDDED} FROM schedules s LEFT JOIN categories c ON c.id = s.category_id"""


def _lookup() -> str:
    return f"""{_with(TRANSACTIONS)}
SELECT * FROM transactions WHERE (id, user_id) IN (
  SELECT o_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R')"""


def _segment(segment: str) -> str:
    return f"SELECT c_custkey FROM customer WHERE c_mktsegment = '{segment}'"


# --- changes ---------------------------------------------------------------

ROW = "id, user_id, category_id, amount, note, date, type, created_at"
KEEPERS = "name NOT IN ('Misc', 'expense 1') OR is_default IS NOT FALSE"


def _append() -> str:
    return f"""{_with(TRANSACTIONS)}
SELECT {ROW} FROM transactions
UNION ALL
SELECT -id, user_id, category_id, amount, NULL,
       CASE WHEN id % 2 = 0 THEN date ELSE {AS_OF} END, type, NULL
FROM transactions WHERE id % 17 = 0"""


def _append_then_report() -> str:
    added = f"""(SELECT user_id, amount, type, date FROM transactions UNION ALL
       SELECT user_id, amount, type, CASE WHEN id % 2 = 0 THEN date ELSE {AS_OF} END
       FROM transactions WHERE id % 17 = 0)"""
    return _annual_report(YEAR, added)


def _update_date_then_report() -> str:
    moved = """(SELECT * REPLACE (CASE WHEN id % 11 = 0
       THEN CAST(date + INTERVAL 12 MONTH AS DATE) ELSE date END AS date) FROM transactions)"""
    return _annual_report(YEAR, moved)


def _run_then_report() -> str:
    due = _expand(None, anchored=True)
    report = _annual_report(2000, "(SELECT user_id, amount, type, date FROM transactions UNION ALL"
                            " SELECT CAST(user_id AS BIGINT), amount, type, date FROM due)")
    head, tail = report.split(",\nmonthly AS", 1)
    return (
        f"{head.replace('WITH', 'WITH due AS (' + due + '),', 1)},\nmonthly AS{tail}"
        .replace("SELECT u.user_id, s.m AS month_number", "SELECT CAST(u.user_id AS VARCHAR) AS user_id, s.m AS month_number")
    )


def _update() -> str:
    hit = "id % 11 = 0 AND id % 33 <> 0"
    return f"""{_with(TRANSACTIONS)}
SELECT id, user_id,
       CASE WHEN {hit} AND id % 5 = 0 THEN NULL ELSE category_id END AS category_id,
       CAST(CASE WHEN {hit} THEN amount + 1 ELSE amount END AS DECIMAL(12,2)) AS amount,
       CASE WHEN {hit} THEN CASE WHEN id % 4 = 0 THEN 'reviewed' END ELSE note END AS note,
       date, type, created_at
FROM transactions"""


def _guarded() -> str:
    return f"""{_with(CATEGORIES)}
SELECT id, user_id, CASE WHEN is_default THEN name ELSE upper(name) END AS name, type, icon,
       CASE WHEN is_default THEN color ELSE '#123456' END AS color, is_default
FROM categories WHERE {KEEPERS}"""


def _set_null() -> str:
    kept = "CASE WHEN category_id IN (SELECT id FROM kept) THEN category_id END AS category_id"
    return f"""{_with(CATEGORIES, TRANSACTIONS, SCHEDULES)},
kept AS (SELECT id FROM categories WHERE {KEEPERS})
SELECT 'transactions' AS table_name, id, user_id, {kept}, amount FROM transactions
UNION ALL SELECT schedule, id, user_id, {kept}, amount FROM schedules
UNION ALL SELECT 'categories', id, user_id, NULL, NULL FROM categories WHERE {KEEPERS}"""


def _cascade() -> str:
    stay = f"NOT IN ({_segment('HOUSEHOLD')})"
    owned = "\n".join(
        f"UNION ALL SELECT '{t}', id, user_id, NULL FROM {t} WHERE user_id {stay}"
        for t in ("categories", "financial_goals")
    )
    # Every seventh row refers to the next user's category.
    refers = "CASE WHEN id % 7 = 0 THEN category_id + 100 ELSE category_id END"
    left = f"CASE WHEN {refers} NOT IN (SELECT id FROM lost) THEN {refers} END"
    return f"""{_with(PROFILES, CATEGORIES, TRANSACTIONS, GOALS, SCHEDULES)},
lost AS (SELECT id FROM categories WHERE NOT (user_id {stay}))
SELECT 'profiles' AS table_name, id, id AS user_id, NULL AS category_id FROM profiles WHERE id {stay}
{owned}
UNION ALL SELECT 'transactions', id, user_id, {left} FROM transactions WHERE user_id {stay}
UNION ALL SELECT schedule, id, user_id, {left} FROM schedules WHERE user_id {stay}"""


DEFAULTS = (
    "(VALUES " + ", ".join(map(str, DEFAULT_CATEGORIES)) + ") AS d(name, type, icon, color)"
)


def _seed() -> str:
    return f"""WITH hashed AS (
  SELECT c_custkey AS user_id, d.*, md5(concat_ws('|', c_custkey, 'default', type, name)) AS h
  FROM customer, {DEFAULTS})
SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4),
                 substr(h, 21, 12)) AS id,
       user_id, name, type, icon, color, true AS is_default
FROM hashed"""


def _onboard() -> str:
    return f"""{_with(PROFILES, CATEGORIES)},
fresh AS (SELECT * FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) >= 0)
SELECT CAST(id AS VARCHAR) AS id, id AS user_id, 'profile' AS row_kind, name, email AS detail, currency AS label,
       CAST(initial_balance AS VARCHAR) AS value
FROM profiles WHERE initial_balance < 0
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), c_custkey, 'profile', CASE WHEN c_nationkey > 4 THEN c_name ELSE '' END,
       lower(c_mktsegment) || '@example.org', 'USD', '0.00' FROM fresh
UNION ALL
SELECT CAST(id AS VARCHAR), user_id, 'category', name, type, icon, color FROM categories
UNION ALL
SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)),
       c_custkey, 'category', name, type, icon, color
FROM (SELECT *, md5(concat_ws('|', c_custkey, 'default', type, name)) AS h FROM fresh, {DEFAULTS})"""


def _balances() -> str:
    return f"""{_with(PROFILES)},
asked AS (SELECT p.*, c_mktsegment AS segment FROM profiles p JOIN customer ON c_custkey = id)
SELECT id, CAST(CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN initial_balance
                ELSE initial_balance + 100 END AS DECIMAL(12,2)) AS initial_balance,
       CAST(NULL AS VARCHAR) AS error
FROM asked
UNION ALL
SELECT id, NULL, CASE segment WHEN 'BUILDING' THEN 'Initial balance must be a valid number'
                 ELSE 'Initial balance is required' END
FROM asked WHERE segment IN ('BUILDING', 'MACHINERY')"""


def _insert_goals() -> str:
    return f"""{_with(GOALS)}
SELECT * FROM financial_goals
UNION ALL
SELECT -id, user_id, 'Rainy days', target_amount,
       CASE WHEN current_amount > 5000 THEN current_amount ELSE 0 END, NULL, 'in_progress'
FROM financial_goals"""


def _other_updates() -> str:
    return f"""{_with(PROFILES, GOALS, SCHEDULES)}
SELECT 'profiles' AS table_name, id, CASE WHEN id % 3 = 1 THEN 'renamed' ELSE name END AS name,
       CASE WHEN id % 2 = 0 THEN '0.00' ELSE CAST(initial_balance AS VARCHAR) END AS value
FROM profiles
UNION ALL
SELECT 'financial_goals', id, CASE WHEN id % 5 = 0 THEN 'cancelled' ELSE status END,
       CASE WHEN id % 5 <> 0 THEN CAST(deadline AS VARCHAR) END
FROM financial_goals
UNION ALL
SELECT schedule, id, CASE WHEN id % 4 = 0 THEN 'paused' ELSE note END,
       CASE WHEN id % 4 = 0 THEN 'false' ELSE CAST(is_active AS VARCHAR) END
FROM schedules"""


def _insert_valid_schedules() -> str:
    return f"""{_with(SCHEDULES)},
costs AS (SELECT * FROM schedules WHERE schedule = 'fixed_costs')
SELECT id, user_id, amount, frequency, start_date, end_date, note, is_active FROM costs
UNION ALL
SELECT -id, 1, amount, frequency, start_date, end_date, CASE WHEN id % 9 = 8 THEN 'rent' END,
       coalesce(is_active, true)
FROM costs WHERE id % 9 IN (0, 6, 8)"""


# New rows, moves and new categories, then users deleted with all they own.
CHANGED = f"""
enlarged AS (
  SELECT id, user_id, category_id, amount, date, type FROM transactions
  UNION ALL
  SELECT -id, user_id, category_id, amount, CASE WHEN id % 2 = 0 THEN date ELSE {AS_OF} END, type
  FROM transactions WHERE id % 17 = 0 AND id <> 0),
edited AS (
  SELECT id, user_id, CASE WHEN id % 7 = 0 THEN (user_id + 1) * 100 + 11 ELSE category_id END AS category_id,
         amount, CASE WHEN id % 11 = 0 THEN CAST(date + INTERVAL 12 MONTH AS DATE) ELSE date END AS date, type
  FROM enlarged),
left_users AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'),
changed AS (
  SELECT id, user_id,
         CASE WHEN category_id NOT IN (SELECT id FROM categories WHERE user_id IN (SELECT c_custkey FROM left_users))
           THEN category_id END AS category_id,
         amount, date, type
  FROM edited WHERE user_id NOT IN (SELECT c_custkey FROM left_users))"""


def _rollup_after_changes() -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS, CHANGED)}
SELECT user_id, category_id, type, CAST(date_trunc('month', date) AS DATE) AS date,
       {_money("sum(amount)")} AS amount, count(*) AS n, max(date) AS last_date
FROM changed GROUP BY 1, 2, 3, 4"""


def _report_after_changes() -> str:
    report = _annual_report(YEAR, "changed").replace("(SELECT id AS user_id FROM profiles) u",
        "(SELECT id AS user_id FROM profiles WHERE id NOT IN (SELECT c_custkey FROM left_users)) u")
    return report.replace("WITH", f"WITH {CATEGORIES},", 1).replace(",\nmonthly AS", f",{CHANGED},\nmonthly AS", 1)


def _gate() -> str:
    rules = {
        "amount not null": "amount IS NULL",
        "type domain": "type = 'gift'",
        "amount range": "abs(amount) >= 10000000000",
        "user_id reference": "user_id NOT IN (SELECT id FROM profiles)",
        "category_id reference": "category_id NOT IN (SELECT id FROM categories)",
        "id unique": "id IN (SELECT id FROM transactions) OR count(*) OVER (PARTITION BY id) > 1",
    }
    broken = ", ".join(f"CASE WHEN {wrong} THEN '{rule}' END" for rule, wrong in rules.items())
    return f"""{_with(PROFILES, CATEGORIES, TRANSACTIONS)},
asked AS (SELECT * FROM transactions WHERE id % 5 = 0 UNION ALL SELECT * FROM transactions WHERE id % 35 = 0),
batch AS (
  SELECT CASE WHEN id % 3 = 0 THEN id ELSE -id END AS id,
         CASE WHEN id % 25 = 0 THEN id + 1000000000 ELSE user_id END AS user_id,
         CASE WHEN id % 4 = 0 THEN -category_id ELSE category_id END AS category_id,
         CASE WHEN id % 11 = 0 THEN CAST(amount AS DECIMAL(30,2)) * 1000000 WHEN id % 7 <> 0 THEN amount END AS amount,
         CASE WHEN id % 6 = 0 THEN 'gift' ELSE type END AS type
  FROM asked)
SELECT id, user_id, category_id, CAST(amount AS DECIMAL(29,2)) AS amount, concat_ws('; ', {broken}) AS broken_rules FROM batch"""


def _scoped_changes() -> str:
    return f"""{_with(TRANSACTIONS)}
SELECT 'row' AS what, id, user_id,
       CASE WHEN id % 11 = 0 AND id % 33 <> 0 AND id % 22 <> 0 THEN 'seen' END AS detail
FROM transactions WHERE id % 13 <> 0 OR id % 39 = 0
UNION ALL SELECT 'row', -id, user_id, NULL FROM transactions WHERE id % 17 = 0 AND id % 34 <> 0
UNION ALL SELECT 'insert', -id, user_id + 1, 'row of another user' FROM transactions WHERE id % 34 = 0 AND id <> 0
UNION ALL
SELECT 'update', id, user_id + CASE WHEN id % 33 = 0 THEN 1 ELSE 0 END,
       CASE WHEN id % 33 = 0 THEN 'row not visible' ELSE 'row of another user' END
FROM transactions WHERE id % 33 = 0 OR id % 22 = 0
UNION ALL SELECT 'delete', id, user_id + 1, 'row not visible' FROM transactions WHERE id % 39 = 0"""


# --- quality ---------------------------------------------------------------

NUMBER = r"^[+-]?([0-9]*[.])?[0-9]+$"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _bad_date(column: str) -> str:
    """Given, but not a date; an absent optional date is fine."""
    good = f"regexp_matches({column}, '{ISO}') AND TRY_CAST({column} AS DATE) IS NOT NULL"
    return f"{column} IS NOT NULL AND NOT ({good})"


def _below(column: str, low: str) -> str:
    return f"NOT coalesce(TRY_CAST({column} AS DOUBLE) >= {low}, false)"


# Messages of broken rules, by field.
TRANSACTION_MESSAGES = {
    "amount": "Amount must be a number",
    "type": "Invalid transaction type",
    "date": "Invalid date format",
    "category_id": "Invalid category ID",
}
GOAL_MESSAGES = {
    "name": "Name is required",
    "target_amount": "Target amount must be greater than 0",
    "current_amount": "Current amount must be 0 or greater",
    "deadline": "Deadline must be a valid date",
    "status": "Invalid status",
    "user_id": "User ID is required",
}
SCHEDULE_MESSAGES = {
    "amount": "Amount must be greater than 0",
    "frequency": "Invalid frequency",
    "start_date": "Start date must be a valid date",
    "end_date": "End date must be a valid date",
    "category_id": "Category ID must be a valid UUID",
    "is_active": "Is active must be a boolean",
    "expected_return_rate": "Expected return rate must be a valid percentage",
    "investment_type": "Investment type is required",
}


def _verdict(rules: dict[str, str], messages: dict[str, str], *shown: str) -> str:
    """``rules``: field -> condition under which it is wrong (NULL: fine)."""

    def listed(separator: str, names: dict[str, str]) -> str:
        cases = (f"CASE WHEN {wrong} THEN '{names[field]}' END" for field, wrong in rules.items())
        return f"concat_ws('{separator}', {', '.join(cases)})"

    fields = listed(",", {field: field for field in rules})
    columns = "".join(f"{c}, " for c in shown)
    return (
        f"SELECT id, {columns}{fields} = '' AS is_valid, {fields} AS error_fields,"
        f" {listed('; ', messages)} AS messages FROM raw"
    )


def _uuid_text(number: str) -> str:
    return f"'00000000-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0')"


def _validate_transactions() -> str:
    raw = f"""
raw AS (
  SELECT CAST(id AS VARCHAR) AS id,
         CASE WHEN id % 9 = 1 THEN 'abc' ELSE CAST(amount AS VARCHAR) END AS amount,
         CASE WHEN id % 9 = 2 THEN 'gift' ELSE type END AS type,
         CASE WHEN id % 9 = 3 THEN '2001-13-01' ELSE CAST(date AS VARCHAR) END AS date,
         CASE WHEN id % 9 = 4 THEN '' ELSE {_uuid_text("coalesce(category_id, 0)")} END
           AS category_id
  FROM transactions)"""
    rules = {
        "amount": f"NOT regexp_matches(amount, '{NUMBER}')",
        "type": "type NOT IN ('expense', 'income', 'investment')",
        "date": _bad_date("date"),
        "category_id": f"NOT regexp_matches(category_id, '{UUID}')",
    }
    return f"{_with(TRANSACTIONS, raw)}\n{_verdict(rules, TRANSACTION_MESSAGES)}"


def _validate_goals() -> str:
    raw = """
raw AS (
  SELECT CAST(id AS VARCHAR) AS id,
         CASE WHEN id % 9 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
         CASE WHEN id % 9 = 2 THEN '' ELSE name END AS name,
         CASE WHEN id % 9 = 3 THEN '0.00' ELSE CAST(target_amount AS VARCHAR) END AS target_amount,
         CASE WHEN id % 9 = 4 THEN '-1' WHEN id % 9 <> 5 THEN CAST(current_amount AS VARCHAR) END
           AS current_amount,
         CASE WHEN id % 9 = 6 THEN 'next May' ELSE CAST(deadline AS VARCHAR) END AS deadline,
         CASE WHEN id % 9 = 7 THEN 'paused' ELSE status END AS status
  FROM financial_goals)"""
    rules = {
        "name": "name = ''",
        "target_amount": _below("target_amount", "0.01"),
        "current_amount": f"current_amount IS NOT NULL AND {_below('current_amount', '0')}",
        "deadline": _bad_date("deadline"),
        "status": "status NOT IN ('in_progress', 'completed', 'cancelled')",
        "user_id": "user_id = ''",
    }
    return f"{_with(GOALS, raw)}\n{_verdict(rules, GOAL_MESSAGES, 'name')}"


RAW_SCHEDULES = f"""
raw AS (
  SELECT CAST(id AS VARCHAR) AS id, schedule,
         CASE WHEN id % 9 = 1 THEN '0' ELSE CAST(amount AS VARCHAR) END AS amount,
         CASE WHEN id % 9 = 2 THEN 'hourly' WHEN frequency = 'annually' THEN 'yearly'
           ELSE frequency END AS frequency,
         CASE WHEN id % 9 = 3 THEN '1999-02-30' ELSE CAST(start_date AS VARCHAR) END AS start_date,
         CASE WHEN id % 9 = 4 THEN ' 2001-1-5' ELSE CAST(end_date AS VARCHAR) END AS end_date,
         CASE WHEN id % 9 = 5 THEN 'none' WHEN id % 9 <> 6 THEN {_uuid_text("category_id")} END
           AS category_id,
         CASE WHEN id % 9 = 7 THEN 'maybe' ELSE CAST(is_active AS VARCHAR) END AS is_active,
         CASE WHEN id % 9 = 8 THEN 'rent' END AS note,
         CASE WHEN id % 10 = 1 THEN '1000' WHEN id % 10 = 2 THEN '-101'
           ELSE CAST(expected_return_rate AS VARCHAR) END AS expected_return_rate,
         CASE WHEN id % 10 <> 3 THEN investment_type END AS investment_type
  FROM schedules)"""
SCHEDULE_RULES = {
    "amount": _below("amount", "0.01"),
    "frequency": "frequency NOT IN ('daily', 'weekly', 'biweekly', 'monthly', 'quarterly',"
    " 'annually', 'yearly')",
    "start_date": _bad_date("start_date"),
    "end_date": _bad_date("end_date"),
    "category_id": f"NOT regexp_matches(category_id, '{UUID}')",
    "is_active": "is_active NOT IN ('true', 'false', '1', '0')",
}
INVESTMENT_RULES = {
    **SCHEDULE_RULES,
    "expected_return_rate": "NOT CAST(expected_return_rate AS DOUBLE) BETWEEN -100 AND 999.99",
    "investment_type": "investment_type IS NULL",
}


def _typed_goals() -> str:
    return f"""{_with(GOALS)}
SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, name, target_amount,
       CASE WHEN id % 9 <> 5 THEN current_amount END AS current_amount, deadline, status
FROM financial_goals WHERE id % 9 IN (0, 5, 8)"""


def _typed_investments() -> str:
    return f"""{_with(SCHEDULES)}
SELECT CAST(id AS VARCHAR) AS id, amount, frequency, start_date, end_date,
       CASE WHEN id % 9 <> 6 THEN {_uuid_text("category_id")} END AS category_id, is_active,
       CASE WHEN id % 9 = 8 THEN 'rent' END AS note, expected_return_rate, investment_type
FROM schedules WHERE schedule = 'fixed_investments' AND id % 9 IN (0, 6, 8) AND id % 10 NOT IN (1, 2, 3)"""


def _check_constraints() -> str:
    checks = [
        "SELECT 'transactions' AS table_name, 'amount not null' AS rule, id AS row_id"
        " FROM damaged WHERE amount IS NULL",
        "SELECT 'transactions', 'amount range', id FROM damaged WHERE abs(amount) >= 10000000000",
        "SELECT 'transactions', 'type domain', id FROM damaged WHERE type = 'gift'",
        "SELECT 'transactions', 'id unique', id FROM damaged GROUP BY id HAVING count(*) > 1",
        "SELECT 'transactions', 'category_id reference', id FROM damaged"
        " WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM labels_left)",
        "SELECT schedule, 'category_id reference', id FROM schedules"
        " WHERE category_id NOT IN (SELECT id FROM labels_left)",
        "SELECT schedule, 'user_id reference', id FROM schedules"
        " WHERE user_id NOT IN (SELECT id FROM solvent)",
    ]
    checks += [
        f"SELECT '{name}', 'user_id reference', id FROM {source}"
        " WHERE user_id NOT IN (SELECT id FROM solvent)"
        for name, source in (
            ("transactions", "damaged"),
            ("categories", "labels_left"),
            ("financial_goals", "financial_goals"),
        )
    ]
    return f"""{_with(PROFILES, CATEGORIES, TRANSACTIONS, GOALS, SCHEDULES)},
solvent AS (SELECT * FROM profiles WHERE initial_balance >= 0),
labels_left AS (SELECT * FROM categories WHERE name <> 'Misc'),
damaged_once AS (
  SELECT id, user_id, category_id,
         CASE WHEN id % 19 = 2 THEN CAST(amount AS DECIMAL(30,2)) * 1000000
              WHEN id % 19 <> 1 THEN amount END AS amount,
         CASE WHEN id % 9 = 2 THEN 'gift' ELSE type END AS type
  FROM transactions),
damaged AS (SELECT * FROM damaged_once
            UNION ALL SELECT * FROM damaged_once WHERE id % 17 = 0)
SELECT table_name, rule, CAST(row_id AS VARCHAR) AS row_id FROM (
  {" UNION ALL ".join(checks)})"""


def _warn() -> str:
    return f"""{_with(CATEGORIES, TRANSACTIONS, SCHEDULES)},
linked AS (SELECT t.*, c.type AS category_type, c.user_id AS owner
           FROM transactions t JOIN categories c ON c.id = t.category_id)
SELECT schedule AS table_name, 'end_date before start_date' AS rule, CAST(id AS VARCHAR) AS row_id
FROM schedules WHERE end_date < start_date
UNION ALL
SELECT 'transactions', 'type differs from category', CAST(id AS VARCHAR)
FROM linked WHERE type <> category_type
UNION ALL
SELECT 'transactions', 'category of another user', CAST(id AS VARCHAR)
FROM linked WHERE user_id <> owner"""


def _monthly_totals() -> str:
    return f"""{_with(TRANSACTIONS)}
SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, type,
       {_money("sum(amount)")} AS total_amount, count(*) AS transaction_count
FROM transactions GROUP BY ALL"""


ORACLE: dict[str, str] = {
    "monthly_calendar": _calendar(),
    "monthly_report": _monthly_report(),
    "category_trend": _category_trend(2001),
    "category_trend_full_year": _category_trend(YEAR),
    "annual_report": _annual_report(2001),
    "annual_report_full_year": _annual_report(YEAR),
    "annual_trend": _annual_trend(YEAR),
    "annual_categories": _category_shares(IN_YEAR.format(YEAR)),
    "all_time_balance": _all_time_balance(),
    "all_time_categories": _category_shares("true"),
    "top_categories_all_time": _top_all_time(),
    "recent_years_summary": _recent_years(),
    "top_categories_recent_years": _top_recent_years(),
    "yearly_trends": _yearly_trends(),
    "yearly_trends_expense": _yearly_trends("type = 'expense'"),
    "category_breakdown": _category_breakdown(),
    "all_time_totals": _all_time_totals(),
    "monthly_summary_nested": _monthly_summary(),
    "expand_fixed_costs": _expand("fixed_costs"),
    "expand_periodic_income": _expand("periodic_income"),
    "expand_fixed_investments": _expand("fixed_investments"),
    "expand_all_schedules": _expand(None),
    "expand_all_schedules_anchored": _expand(None, anchored=True),
    "advance_schedules": _advance(),
    "run_due_schedules": _run_due(),
    "list_transactions": _list_transactions(),
    "list_transactions_by_date": _list_transactions(f"date = {DAY}"),
    "lookup_by_key": _lookup(),
    "list_categories": f"{_with(CATEGORIES)}\nSELECT * FROM categories WHERE type = 'expense'",
    "list_all_categories": f"{_with(CATEGORIES)}\nSELECT * FROM categories",
    "list_goals": f"{_with(GOALS)}\nSELECT * FROM financial_goals",
    "list_schedules": _list_schedules(),
    "get_profiles": f"{_with(PROFILES)}\nSELECT * FROM profiles"
    f" WHERE id IN ({_segment('MACHINERY')})",
    "scope_to_user": f"{_with(TRANSACTIONS)}\nSELECT {ROW} FROM transactions"
    f" WHERE user_id IN ({_segment('MACHINERY')})",
    "append_transactions": _append(),
    "apply_updates": _update(),
    "apply_deletes": f"{_with(TRANSACTIONS)}\nSELECT {ROW} FROM transactions WHERE id % 13 <> 0",
    "category_changes_guarded": _guarded(),
    "delete_categories_set_null": _set_null(),
    "delete_profiles_cascade": _cascade(),
    "seed_default_categories": _seed(),
    "onboard_users": _onboard(),
    "update_initial_balances": _balances(),
    "insert_with_defaults": _insert_goals(),
    "update_other_tables": _other_updates(),
    "insert_valid_schedules": _insert_valid_schedules(),
    "append_then_annual_report": _append_then_report(),
    "update_date_then_annual_report": _update_date_then_report(),
    "run_schedules_then_report": _run_then_report(),
    "all_time_balance_stored": _all_time_balance(),
    "all_time_balance_rollup": _all_time_balance(),
    "top_categories_rollup": _top_all_time(),
    "rollup_after_changes": _rollup_after_changes(),
    "transactions_after_changes": f"{_with(CATEGORIES, TRANSACTIONS, CHANGED)}\nSELECT * FROM changed",
    "annual_report_after_changes": _report_after_changes(),
    "balance_after_backdated": _all_time_balance(),
    "gate_new_transactions": _gate(),
    "scoped_changes": _scoped_changes(),
    "sql_monthly_calendar": _calendar(),
    "sql_monthly_report": _monthly_report(),
    "sql_category_trend": _category_trend(2001),
    "sql_annual_report": _annual_report(2001),
    "sql_annual_trend": _annual_trend(YEAR),
    "sql_annual_categories": _category_shares(IN_YEAR.format(YEAR)),
    "sql_all_time_balance": _all_time_balance(),
    "sql_all_time_categories": _category_shares("true"),
    "sql_top_categories_all_time": _top_all_time(),
    "sql_recent_years_summary": _recent_years(),
    "sql_top_categories_recent_years": _top_recent_years(),
    "validate_transactions": _validate_transactions(),
    "validate_goals": _validate_goals(),
    "validate_schedules": f"{_with(SCHEDULES, RAW_SCHEDULES)}\n"
    + _verdict(SCHEDULE_RULES, SCHEDULE_MESSAGES, "note")
    + " WHERE schedule IN ('fixed_costs', 'periodic_income')",
    "validate_investments": f"{_with(SCHEDULES, RAW_SCHEDULES)}\n"
    + _verdict(INVESTMENT_RULES, SCHEDULE_MESSAGES, "investment_type")
    + " WHERE schedule = 'fixed_investments'",
    "typed_goals": _typed_goals(),
    "typed_investments": _typed_investments(),
    "check_constraints": _check_constraints(),
    "warn_inconsistencies": _warn(),
    "refresh_monthly_totals": _monthly_totals(),
    "refresh_redelivered": _monthly_totals(),
    "onboard_stream": _onboard(),
    "monthly_totals": _monthly_totals(),
}
