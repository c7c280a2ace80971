"""Canonical forms of dirty text columns, so that another writing is no difference."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Party names and the code each is delivered as.
PARTY_CODES = {
    "DEMOCRATIC": "DEM",
    "REPUBLICAN": "REP",
    "INDEPENDENT": "IND",
    "GREEN": "GRN",
    "LIBERTARIAN": "LIB",
    "WORKING FAMILIES": "WFP",
    "NO PARTY": "NPA",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def squeezed(text: Column) -> Column:
    """Upper case, blanks squeezed to one and trimmed; NULL if nothing is left."""
    one = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return let(F.upper(one), lambda t: F.nullif(t, F.lit("")))


def coded(text: Column, codes: Mapping[str, str] = PARTY_CODES) -> Column:
    """``squeezed``, with full names replaced by their codes."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return let(squeezed(text), lambda value: F.coalesce(F.try_element_at(table, value), value))


def dated(text: Column) -> Column:
    """A date written ``yyyy-mm-dd`` (a time may follow), ``m/d/yyyy`` or ``yyyymmdd``, in ISO
    form; other text squeezed as it is, so that two unreadable dates compare as texts."""
    iso = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d*)?)?)?$"

    def read(raw: Column) -> Column:
        time = F.when(raw.rlike(iso), F.try_to_timestamp(F.regexp_extract(raw, iso, 1), F.lit("y-M-d")))
        time = time.when(raw.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(raw, F.lit("M/d/y")))
        time = time.when(raw.rlike(r"^\d{8}$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
        return F.coalesce(F.date_format(time, "yyyy-MM-dd"), raw)

    return let(squeezed(text), read)
