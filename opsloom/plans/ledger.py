"""Refund and grant measures over the credit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.measures import count_when, sum_when

# Transaction type, name of the measure, sign of its amount.
LEDGER_TYPES = [(3, "refunds", 1), (4, "grants", 1), (5, "monetary_refunds", -1), (8, "cc_refunds", 1)]
LEDGER_MEASURES = [m for _, name, _ in LEDGER_TYPES for m in (f"num_{name}", f"{name}_amount")]


def ledger_measures(credit_log: DataFrame, day: Column) -> DataFrame:
    """Count and cents per transaction type, by performing user and day, without entries on one's own account."""
    kind = F.col("cre_transaction_type")
    cents = F.col("cre_adjustment_paid_cents") + F.col("cre_adjustment_promotional_cents")
    aggregates = []
    for code, name, sign in LEDGER_TYPES:
        aggregates.append(count_when(kind == code, F.col("cre_credit_log_id")).alias(f"num_{name}"))
        aggregates.append(sum_when(kind == code, cents if sign > 0 else -cents).alias(f"{name}_amount"))
    return (
        credit_log.filter(
            (F.col("cre_usr_user_id") != F.col("cre_performing_usr_user_id"))
            & kind.isin([code for code, _, _ in LEDGER_TYPES])
        )
        .groupBy("cre_performing_usr_user_id", day)
        .agg(*aggregates)
    )
