"""Scalar functions, as Columns and as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Election type codes and the suffix each stands for.
ELECTION_SUFFIXES = {"pr": "primary", "ge": "general", "pp": "presidential_primary", "sp": "special"}

#: Fixed value: the form of an e-mail address up to the end of the text.
EMAIL_FORM = r"^\S*\.[a-zA-Z][a-zA-Z\.]*[a-zA-Z]"


def election_name(date: Column, kind: Column) -> Column:
    """``2012_general`` from a date text and a type code; an unknown code stands for itself in
    lower case.  A NULL gives NULL, a text that is no date raises."""
    code = F.lower(kind)
    suffix = code
    for short, long in ELECTION_SUFFIXES.items():
        suffix = F.when(code == short, F.lit(long)).otherwise(suffix)
    return F.concat(F.year(date.cast("date")).cast("string"), F.lit("_"), suffix)


def date_or_null(text: Column) -> Column:
    """A date from ``yyyy-mm-dd``, ``m/d/yyyy`` or ``yyyymmdd``, NULL for anything else."""
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), text.try_cast("date"))
    slashes = F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))
    compact = F.when(text.rlike(r"^[0-9]{8}\z"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
    return F.coalesce(iso, slashes, compact)


def email_valid(text: Column) -> Column:
    """True for NULL and the empty text; else 3 to 100 characters with an ``@`` that end in a
    dot and a last label of two or more letters."""
    fits = F.length(text).between(3, 100) & text.contains("@") & text.rlike(EMAIL_FORM + r"\z")
    return F.when(text.isNull() | (text == ""), F.lit(True)).otherwise(fits)


_SQL = {
    "election_name": "CREATE OR REPLACE TEMPORARY FUNCTION election_name(d STRING, t STRING) RETURNS STRING RETURN concat(CAST(year(CAST(d AS DATE)) AS STRING), '_', CASE lower(t) "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ELECTION_SUFFIXES.items())
    + " ELSE lower(t) END)",
    "date_or_null": r"""CREATE OR REPLACE TEMPORARY FUNCTION date_or_null(x STRING) RETURNS DATE RETURN coalesce(
        CASE WHEN x RLIKE r'^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z' THEN try_cast(x AS DATE) END,
        CASE WHEN x RLIKE r'^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z' THEN CAST(try_to_timestamp(x, 'M/d/yyyy') AS DATE) END,
        CASE WHEN x RLIKE r'^[0-9]{8}\z' THEN CAST(try_to_timestamp(x, 'yyyyMMdd') AS DATE) END)""",
    "email_valid": rf"""CREATE OR REPLACE TEMPORARY FUNCTION email_valid(x STRING) RETURNS BOOLEAN RETURN
        CASE WHEN x IS NULL OR x = '' THEN true
        ELSE length(x) BETWEEN 3 AND 100 AND contains(x, '@') AND x RLIKE r'{EMAIL_FORM}\z' END""",
}


def load_extension(spark: SparkSession, name: str) -> None:
    """Register one of the scalar functions under its name for SQL text.

    Raises ``NameError`` for a name that is not supported.
    """
    if name not in _SQL:
        raise NameError(f"no extension {name!r}; there are {', '.join(sorted(_SQL))}")
    spark.sql(_SQL[name])
