"""Small hand-written ledgers."""

from datetime import date
from decimal import Decimal

from ledgerloom.model import SCHEMAS, Ledger

DEFAULTS = {
    "profiles": {"currency": "USD", "initial_balance": Decimal(0)},
    "categories": {"icon": "i", "color": "c", "is_default": False},
    "transactions": {},
    "financial_goals": {"target_amount": Decimal(1), "status": "in_progress"},
    "fixed_costs": {"is_active": True},
    "periodic_income": {"is_active": True},
    "fixed_investments": {"is_active": True, "investment_type": "Stocks"},
}


def _typed(value):
    return Decimal(str(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def table(spark, name, rows):
    schema = SCHEMAS[name]
    data = [
        tuple(_typed({**DEFAULTS[name], **row}.get(field)) for field in schema.names) for row in rows
    ]
    return spark.createDataFrame(data, schema)


def ledger(spark, **rows) -> Ledger:
    return Ledger(**{name: table(spark, name, rows.get(name, [])) for name in SCHEMAS})


def profile(id, balance=0, **more):
    return {"id": id, "initial_balance": balance, **more}


def category(id, user, kind, name=None, **more):
    return {"id": id, "user_id": user, "type": kind, "name": name or id, **more}


def transaction(id, user, kind, amount, day, category_id=None, **more):
    return {
        "id": str(id),
        "user_id": user,
        "type": kind,
        "amount": amount,
        "date": date.fromisoformat(day),
        "category_id": category_id,
        **more,
    }


def schedule(id, user, amount, frequency, start, end=None, mark=None, **more):
    def day(text):
        return None if text is None else date.fromisoformat(text)

    return {
        "id": id,
        "user_id": user,
        "amount": amount,
        "frequency": frequency,
        "start_date": day(start),
        "end_date": day(end),
        "last_generated_date": day(mark),
        **more,
    }


def rows(df, *columns):
    """Rows as tuples, decimals as text."""
    picked = df.select(*columns) if columns else df
    return [
        tuple(str(v) if isinstance(v, Decimal) else v for v in row) for row in picked.collect()
    ]
