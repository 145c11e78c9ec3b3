"""What every injector returns.

An injector first gathers a handful of scalars (means, medians, which columns qualify) and then
returns the changed table as a plain projection over the input. The scalars are computed once,
however often the table is read afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



@dataclass
class Injection:
    injector: str
    table: DataFrame
    params: dict[str, str]
    effects: dict[str, object] = field(default_factory=dict)
    status: str = "OK"
    reason: str = ""
    groups: DataFrame | None = None

    def reject(self, reason: str) -> "Injection":
        self.status, self.reason = "REJECTED", reason
        return self


def replace_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.select(*[
        value.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns
    ])


def or_one(std: float | None) -> float:
    """Deviation used as a scale: 1 where it is missing or zero."""
    return std if std else 1.0
