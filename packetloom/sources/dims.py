"""Small dimension tables from literal rows.

The rows become an inline relation, so that the optimizer knows the size and
broadcasts the table by itself when it is below the session's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dim:
    """Literal table: ``schema`` is ``name TYPE, ...``."""

    schema: str
    rows: Sequence[tuple]

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(",")]

    @property
    def types(self) -> list[str]:
        return [part.split()[1] for part in self.schema.split(",")]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.sql(spark_dialect=True))

    def sql(self, *, spark_dialect: bool = False) -> str:
        body = ", ".join(
            "(" + ", ".join(_literal(v, spark_dialect) for v in row) + ")" for row in self.rows
        )
        names = ", ".join(f"c{i}" for i in range(len(self.columns)))
        casts = ", ".join(
            f"CAST(c{i} AS {t}) AS {c}" for i, (c, t) in enumerate(zip(self.columns, self.types))
        )
        return f"SELECT {casts} FROM (VALUES {body}) AS t({names})"


def _literal(value, spark_dialect: bool) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        if spark_dialect:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return repr(value) + "D" if spark_dialect else f"CAST({value!r} AS DOUBLE)"
    return str(value)
