"""Column profiles of loads, and loads whose profile departs from their feed.

Everything derives from one table of (feed, load, column, value) counts, which combines before
it shuffles; a load with a third of all rows costs no single task more than its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import let
from ..spec import tick


@dataclass(frozen=True)
class ColumnCheck:
    """A profiled column: ``well_formed`` and ``part`` are functions of the trimmed text.

    ``part`` is the coarse part whose distribution is compared (an area code, a domain, a
    decade); its values are counted like others, and no task holds those of a load.
    """

    name: str
    well_formed: object
    part: object


#: The codes that stand for a gender.
GENDERS = ("f", "m", "x", "u", "female", "male", "unknown", "nonbinary")


def _real_date(text: Column) -> Column:
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    slashes = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy")))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(iso, slashes, compact)


def contact_checks() -> tuple[ColumnCheck, ...]:
    """Checks of phone, email, gender and birth date columns delivered as text."""
    digits = lambda t: F.regexp_replace(t, r"\D", "")
    return (
        ColumnCheck("phone", lambda t: t.rlike(r"^(\+?1[-. ]?)?(\(\d{3}\) ?|\d{3}[-. ]?)\d{3}[-. ]?\d{4}$"), lambda t: let(digits(t), lambda d: F.when(F.length(d) >= 10, F.substring(d, -10, 3)).otherwise("short"))),
        ColumnCheck("email", lambda t: t.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), lambda t: F.when(t.contains("@"), F.lower(F.substring_index(t, "@", -1))).otherwise("none")),
        ColumnCheck("gender", lambda t: F.lower(t).isin(*GENDERS), lambda t: F.lower(t)),
        ColumnCheck("born_at", lambda t: _real_date(t).isNotNull(), lambda t: F.coalesce(F.floor(F.year(_real_date(t)) / 10).cast("string"), F.regexp_extract(t, r"\d{4}", 0))),
    )


def value_shape(text: Column) -> Column:
    """Digits as 9 and runs of letters as a or A: the way a value is written."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), r"\p{Ll}+", "a"), r"\p{Lu}+", "A")
    return F.regexp_replace(shape, "a9+", "a9")


def value_counts(table: DataFrame, checks: Sequence[ColumnCheck], feed: str, load: str) -> DataFrame:
    """(feed, load, column_name, value, n): the exact counts everything else is made of."""
    cols = F.explode(F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.col(tick(c.name)).cast("string").alias("value")) for c in checks]))
    rows = table.select(F.col(tick(feed)).alias("feed"), F.col(tick(load)).alias("load"), cols.alias("c"))
    return rows.groupBy("feed", "load", F.col("c.column_name").alias("column_name"), F.col("c.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def described(counts: DataFrame, checks: Sequence[ColumnCheck]) -> DataFrame:
    """Value counts with state (null, blank, ill, ok), shape and part of each value."""
    text = F.trim(F.col("value"))
    fine, part = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for c in checks:
        here = F.col("column_name") == c.name
        fine, part = F.when(here, c.well_formed(text)).otherwise(fine), F.when(here, c.part(text)).otherwise(part)
    state = F.when(F.col("value").isNull(), "null").when(text == "", "blank").when(fine, "ok").otherwise("ill")

    def views(known: Column) -> Column:
        held = known.isin("ok", "ill")
        return F.struct(known.alias("state"), F.when(held, value_shape(text)).alias("shape"), F.when(held, part).alias("part"))

    return counts.withColumn("_d", let(state, views)).select(*counts.columns, "_d.state", "_d.shape", "_d.part")


def profile(table: DataFrame, checks: Sequence[ColumnCheck], feed: str, load: str) -> DataFrame:
    """Per load and column: rows, nulls, blanks, ill-formed values, distinct values, the range
    of the values as text and of their lengths, and the most frequent value with its count.

    Ranges and distincts are of values that are neither NULL nor blank; without any they are
    NULL and 0.  Exact at any size.
    """
    d = described(value_counts(table, checks, feed, load), checks)
    held = F.col("state").isin("ok", "ill")
    value = F.when(held, F.col("value"))
    return d.groupBy("feed", "load", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("state") == "null", F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.col("state") == "blank", F.col("n"))), F.lit(0)).alias("n_blank"),
        F.coalesce(F.sum(F.when(F.col("state") == "ill", F.col("n"))), F.lit(0)).alias("n_ill"),
        F.count_if(held).alias("n_distinct"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.min(F.length(value)).alias("min_length"),
        F.max(F.length(value)).alias("max_length"),
        F.max(F.when(held, F.col("n"))).alias("top_n"),
        F.max(F.when(held, F.struct("n", "value")))["value"].alias("top_value"),
    )


def _weight(n: Column, t: Column) -> Column:
    """What a value held n times in t adds to the index of a load whose feed usually lacks it.

    Once or twice is no repetition: nothing, as its chi-square alone could never be clear.
    """
    return F.when(n >= 3, n / (t + 1) * F.log(2 * n + 1)).otherwise(0.0)


def _facets(d: DataFrame, least_weight: float) -> DataFrame:
    """(feed, load, column_name, facet, cell, n, t): each load's distribution in four views, in
    one pass over the described value counts."""
    key = ["feed", "load", "column_name"]
    held = F.col("state").isin("ok", "ill")
    totals = d.groupBy(*key).agg(F.sum("n").alias("rows"), F.sum(F.when(held, F.col("n"))).alias("t"), F.max(F.when(held, F.col("n"))).alias("m"))
    repeating = totals.where(_weight(F.col("m"), F.col("t")) >= least_weight).drop("rows", "m")
    heavy = d.where(held).join(repeating, key).where(_weight(F.col("n"), F.col("t")) >= least_weight).select("feed", "column_name", "value").distinct()
    marked = d.join(heavy.withColumn("kept", F.lit(True)), ["feed", "column_name", "value"], "left")
    view = lambda name, cell: F.struct(F.lit(name).alias("facet"), cell.alias("cell"))
    of_values = F.array(view("shape", F.col("shape")), view("part", F.col("part")), view("value", F.when(F.col("kept"), F.col("value")).otherwise(F.lit("~other"))))
    views = F.explode(F.concat(F.array(view("state", F.col("state"))), F.when(held, of_values).otherwise(F.slice(of_values, 1, 0))))
    cells = marked.select(*key, "n", views.alias("v")).groupBy(*key, "v.facet", "v.cell").agg(F.sum("n").alias("n"))
    known = totals.select(*[F.col(c).alias(f"_{c}") for c in key], "rows", F.col("t").alias("held"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return cells.join(known, same).select(*key, "facet", "cell", "n", F.when(F.col("facet") == "state", F.col("rows")).otherwise(F.col("held")).alias("t"))


def drift(table: DataFrame, checks: Sequence[ColumnCheck], feed: str, load: str, least_weight: float = 0.025) -> DataFrame:
    """Per load, column and facet: population stability index and chi-square of the load's
    distribution against its feed's usual one.

    The usual share of a cell is the lower median of its shares over all loads of the feed,
    loads without it counting 0; a few loads that went wrong do not move it.  The value counts
    and the cells, read several times, are each written once.  Facets: state of
    the values, their shape, their coarse part, and the values themselves.  Values that would add
    less than ``least_weight`` to the index of every load, a tenth of what departs, share a cell;
    that leaves a bounded number of cells per load.  Medians are taken over one number per load,
    found by rank.
    """
    from ..session import cut

    described_counts = cut(described(value_counts(table, checks, feed, load), checks))
    cells = cut(_facets(described_counts, least_weight))
    group = ["feed", "column_name", "facet"]
    loads = cells.select(*group, "load", "t").distinct()
    counted = loads.groupBy(*group).agg(F.count(F.lit(1)).alias("loads"))
    ranked = cells.withColumn("share", F.col("n") / F.col("t")).withColumn("r", F.row_number().over(Window.partitionBy(*group, "cell").orderBy(F.col("share").desc(), "load")))
    usual = ranked.join(counted, group).where("r = loads - CAST(floor((loads - 1) / 2) AS INT)").select(*group, "cell", F.col("share").alias("q"))
    usual = usual.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy(*group)))
    expected = usual.join(loads, group).select(*group, "load", "cell", "t", "q", F.lit(0).cast("bigint").alias("n"))
    both = expected.unionByName(cells.select(*group, "load", "cell", "t", F.lit(0.0).alias("q"), "n"))
    both = both.groupBy(*group, "load", "cell").agg(F.max("t").alias("t"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    p, q = (F.col("n") + 0.5) / (F.col("t") + 1), (F.col("q") * F.col("t") + 0.5) / (F.col("t") + 1)
    e = F.col("q") * F.col("t") + 0.5
    out = both.groupBy(*group, "load").agg(
        F.sum((p - q) * F.log(p / q)).alias("psi"),
        F.sum((F.col("n") - F.col("q") * F.col("t")) ** 2 / e).alias("chi_square"),
        F.count_if(F.col("q") > 0).alias("cells"),
        F.max("t").alias("n_values"),
    )
    return out.join(counted, group)


def departing(drifts: DataFrame, psi: float = 0.25, noise: float = 2.0, least_loads: int = 3) -> DataFrame:
    """Columns of loads that clearly depart: (feed, load, column_name, facet, psi, chi_square)
    of the strongest facet.

    A facet departs if its index exceeds ``psi`` plus ``noise`` times what chance alone adds,
    (cells - 1) / values, and its chi-square lies six standard deviations above its mean.
    Feeds of fewer than ``least_loads`` loads have nothing to compare with.
    """
    freedom = F.greatest(F.col("cells") - 1, F.lit(1))
    clear = (F.col("psi") > psi + noise * freedom / F.col("n_values")) & (F.col("chi_square") > freedom + 6 * F.sqrt(2 * freedom)) & (F.col("loads") >= least_loads)
    best = drifts.where(clear).groupBy("feed", "load", "column_name").agg(F.max(F.struct("psi", "chi_square", "facet")).alias("b"))
    return best.select("feed", "load", "column_name", "b.facet", "b.psi", "b.chi_square")
