"""Audits: counts and distributions of files, tables, merges and de-duplications.

Each returns one small DataFrame; nothing is written.  Fractions are NULL for empty input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import MatchSpec, tick
from .dedup import check_links
from .match import STEP

#: The columns of a voter table whose coverage is reported.
COVERAGE_COLUMNS = (
    "county_file_id",
    "state_file_id",
    "phone",
    "email",
    "born_at",
    "age",
    "gender",
    "demo",
    "registered_at",
    "party",
    "is_perm_absentee",
    "residential_address1",
    "residential_lat",
    "residential_lng",
)


def audit_links(links: DataFrame, spec: MatchSpec, fuzzy: bool = False) -> DataFrame:
    """Per top-level group: rows matched and their fraction of all source rows; groups without
    a match count 0.  With ``fuzzy`` the trigram steps follow."""
    steps = len(spec.groups) + (len(spec.fuzzy_columns) if fuzzy else 0)
    spark = links.sparkSession
    counts = links.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(STEP) == i).alias(f"n{i}") for i in range(steps)])
    rows = F.array(*[F.struct(F.lit(i).alias("match_step"), F.col(f"n{i}").alias("n")) for i in range(steps)])
    if not steps:
        return spark.createDataFrame([], "match_step int, n bigint, total bigint, fraction double")
    out = counts.select("total", F.explode(rows).alias("r")).select("r.match_step", "r.n", "total")
    return out.withColumn("fraction", F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")))


def audit_dedup(links: DataFrame, spec: MatchSpec) -> DataFrame:
    """``audit_links`` with the counts of reflexive and chained links beside each group."""
    return audit_links(links, spec).crossJoin(check_links(links, spec.target_key))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: number of duplicated keys and the size of the largest group (0 if unique)."""
    groups = df.groupBy(F.col(tick(key)).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicated_keys"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("largest_group"))


def is_filled(column: Column) -> Column:
    """Not NULL and not only blanks."""
    return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))


def coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the rows that are filled and their fraction, in one pass over the table."""
    names = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(is_filled(F.col(tick(c)))).alias(f"_n{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(names)])
    out = counts.select("_total", F.explode(rows).alias("r")).select("r.column_name", "r.n", F.col("_total").alias("total"))
    return out.withColumn("fraction", F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")))


def distribution(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values with their counts, most frequent first, NULL included; ``top`` keeps the first
    so many.  Ties are in the order of the value as text, NULL last."""
    out = df.groupBy(F.col(tick(column)).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    return out.orderBy(*order).limit(top) if top else out.orderBy(*order)


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``distribution`` of several columns in long form, in one scan and one aggregation."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(tick(c)).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("c")).groupBy("c.column_name", "c.value").agg(F.count(F.lit(1)).alias("n"))


def geocoding_breakdown(df: DataFrame) -> DataFrame:
    """Rows by whether they need geocoding: an address but neither a latitude nor a zip+4."""
    address = F.trim(F.coalesce(F.col("residential_address1").cast("string"), F.lit("")))
    need = (address != "") & (F.col("residential_lat").isNull() | (F.col("residential_lat") == 0)) & F.col("residential_zip4").isNull()
    return df.groupBy(need.alias("needs_geocoding")).agg(F.count(F.lit(1)).alias("n"))


def table_audit(df: DataFrame) -> dict[str, DataFrame]:
    """The reports of a voter table: total, coverage, distributions, latest registrations and
    geocoding, each lazy and under its own name."""
    flat = [c for c in ("is_perm_absentee", "party", "demo", "gender", "born_at", "age") if c in df.columns]
    out = {
        "total": total(df),
        "coverage": coverage(df, [c for c in COVERAGE_COLUMNS if c in df.columns]),
        "distributions": distributions(df, flat) if flat else distributions(df, df.columns[:1]),
    }
    if "reg_status" in df.columns:
        out["reg_status"] = distribution(df, "reg_status")
    if "registered_at" in df.columns:
        out["registered_at_top_20"] = distribution(df, "registered_at", 20)
    if {"residential_address1", "residential_lat", "residential_zip4"} <= set(df.columns):
        out["needs_geocoding"] = geocoding_breakdown(df)
    return out


def percent(fraction: float | None) -> str:
    return "-" if fraction is None else f"{100 * fraction:.1f} %"


def file_report(rows: int, malformed: int, unique: bool, largest_group: int, filled: Sequence[tuple[str, int, float | None]]) -> str:
    """Text report of a delimited file."""
    lines = [f"rows: {rows}", f"malformed rows: {malformed}", "UNIQUE KEY" if unique else f"DUPLICATES (NOT UNIQUE), largest group {largest_group}"]
    return "\n".join([*lines, *(f"{name}: {n} ({percent(share)})" for name, n, share in filled)])


def links_report(rows: Sequence[tuple[int, int, int, float | None]], checks: tuple[int, int] | None = None) -> str:
    """Text report of a merge, and of a de-duplication if ``checks`` are given."""
    lines = [f"source rows: {rows[0][2] if rows else 0}"] + [f"group {step}: {n} ({percent(share)})" for step, n, _, share in rows]
    if checks:
        lines += [f"reflexive matches: {checks[0]}", f"chained matches: {checks[1]}"]
    return "\n".join(lines)
