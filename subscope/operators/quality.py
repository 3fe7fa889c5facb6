"""Checks of stored tables against constraints, and of scoring requests against ranges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Constraint:
    """``kind`` is not_null, unique, foreign or length."""

    kind: str
    table: str
    columns: tuple[str, ...]
    target: tuple[str, str] | None = None
    limit: int | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.table}({','.join(self.columns)})"


def _per_row(rule: Constraint) -> Column:
    column = F.col(rule.columns[0])
    return F.count_if(column.isNull() if rule.kind == "not_null" else F.length(column) > rule.limit)


def check_constraints(tables: dict[str, DataFrame], rules: list[Constraint]) -> DataFrame:
    """One row per constraint with the number of rows that break it.

    The row-wise rules of a table share one scan. Keys are counted before they are
    compared, so a key with many rows costs one row from then on.
    """
    results = []
    for name, df in tables.items():
        row_wise = [r for r in rules if r.table == name and r.kind in ("not_null", "length")]
        if row_wise:
            counted = df.agg(*[_per_row(r).alias(f"r{i}") for i, r in enumerate(row_wise)])
            cells = [F.struct(F.lit(r.name).alias("constraint"), F.col(f"r{i}").alias("violations"))
                     for i, r in enumerate(row_wise)]
            results.append(counted.select(F.inline(F.array(*cells))))
    for rule in rules:
        if rule.kind == "unique":
            present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule.columns])
            broken = (
                tables[rule.table].where(present).groupBy(*rule.columns).count()
                .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
            )
        elif rule.kind == "foreign":
            target, key = rule.target
            column = rule.columns[0]
            counts = tables[rule.table].where(F.col(column).isNotNull()).groupBy(column).count()
            parents = tables[target].select(F.col(key).alias(column))
            broken = counts.join(parents, column, "left_anti").agg(
                F.coalesce(F.sum("count"), F.lit(0)).alias("violations")
            )
        else:
            continue
        results.append(broken.select(F.lit(rule.name).alias("constraint"), "violations"))
    return reduce(DataFrame.unionByName, results)


# Accepted ranges and defaults of a scoring request.
REQUIRED_TEXT = ("gender", "city", "tariff_id", "contract_type", "payment_method")
RANGES = {
    "age": (18, 100),
    "tenure_months": (0, None),
    "paperless_billing": (0, 1),
    "has_internet": (0, 1),
    "has_tv": (0, 1),
    "has_roaming": (0, 1),
}
DEFAULTS = {"recency": 30.0, "frequency": 6.0, "monetary": 5000.0, "avg_data_gb": 15.0, "avg_minutes": 300.0}
SEGMENT_FIELDS = ("recency", "frequency", "monetary", "tenure_months", "avg_data_gb")
REQUEST_DEFAULTS = {"mode": "cold_start", "n": 5}
REQUEST_RANGE = (1, 10)


def _out_of_range(column: str, low, high) -> Column:
    value = F.col(column)
    broken = value < low
    return broken if high is None else broken | (value > high)


def _violations(checks: list[tuple[Column, str]]) -> Column:
    marks = F.array(*[F.when(broken, F.lit(text)) for broken, text in checks])
    return F.filter(marks, lambda m: m.isNotNull())


def validate_features(requests: DataFrame) -> DataFrame:
    """Fill optional fields and list the violated rules of every churn scoring request.

    Rows with an empty ``violations`` array are fit for scoring.
    """
    checks = [(F.col(c).isNull(), f"{c}:missing") for c in (*RANGES, *REQUIRED_TEXT)]
    checks += [(_out_of_range(c, low, high), f"{c}:range") for c, (low, high) in RANGES.items()]
    present = {c: v for c, v in DEFAULTS.items() if c in requests.columns}
    absent = {c: F.lit(v) for c, v in DEFAULTS.items() if c not in requests.columns}
    filled = requests.na.fill(present) if present else requests
    return filled.withColumns(absent).withColumn("violations", _violations(checks))


def validate_recommendation_requests(requests: DataFrame) -> DataFrame:
    """Fill ``mode`` and ``n`` of recommendation requests and list violated rules."""
    low, high = REQUEST_RANGE
    return requests.na.fill(REQUEST_DEFAULTS).withColumn(
        "violations", _violations([(_out_of_range("n", low, high), "n:range")])
    )


def validate_segment_requests(requests: DataFrame) -> DataFrame:
    """List the fields that a segment request lacks; none has a default, any number will do."""
    absent = {c: F.lit(None).cast("double") for c in SEGMENT_FIELDS if c not in requests.columns}
    checks = [(F.col(c).isNull(), f"{c}:missing") for c in SEGMENT_FIELDS]
    return requests.withColumns(absent).withColumn("violations", _violations(checks))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the marker, and rejected rows with it."""
    ok = F.size("violations") == 0
    return validated.where(ok).drop("violations"), validated.where(~ok)
