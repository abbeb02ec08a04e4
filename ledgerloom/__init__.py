"""Personal-ledger analytics as Spark DataFrame operators.

Every operator computes the answer for all users in one distributed pass and
takes an optional ``user_id`` for the one-user answer.  Operators only build
plans: none of them triggers a job.
"""

from ledgerloom.model import Ledger

__all__ = ["Ledger"]
