"""The best representative of each group of duplicate records.

``duplicate_groups`` finds rows of one person within a table by keys that hold for one person
only.  ``ranking`` orders the rows of a group by completeness, trust and recency with a
deterministic tie-break: ``survivors`` takes the first row, ``best_per_field`` the first row for
each field by itself.  Ranking is a
window of which only the first row stays, which Spark cuts inside the partitions before it
shuffles: a group of a third of all rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import let
from ..session import cut
from ..spec import tick
from .blocks import grid_self_join
from .graph import components
from .people import STANDIN_DATES

#: Local parts of addresses that no person owns.
STANDIN_LOCALS = ("noemail", "nomail", "donotmail", "donotemail", "none", "noone", "nobody", "unknown", "test", "na", "noreply", "no", "null", "refused", "email", "mail", "xx", "x")


def usable_phone(value: Column) -> Column:
    """Ten digits, perhaps behind the country's 1, grouped as usual; not a row of equal digits
    nor the digits counted up."""
    text = F.trim(value)
    shaped = text.rlike(r"^(\+?1[-. ]?)?(\(\d{3}\) ?|\d{3}[-. ]?)\d{3}[-. ]?\d{4}$")
    digits = F.substring(F.regexp_replace(text, r"\D", ""), -10, 10)
    standin = let(digits, lambda d: d.rlike(r"^(\d)\1{9}$|^(000|\d{3}000)") | d.isin("1234567890", "0123456789", "9876543210"))
    return F.coalesce(shaped & ~standin, F.lit(False))


def usable_email(value: Column) -> Column:
    """One ``@`` between a local part and a domain with a dot; not a stand-in's local part."""
    text = F.lower(F.trim(value))
    shaped = text.rlike(r"^[a-z0-9._%+'-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$")
    local = F.regexp_replace(F.substring_index(text, "@", 1), r"[^a-z]", "")
    return F.coalesce(shaped & ~local.isin(*STANDIN_LOCALS), F.lit(False))


def usable_address(value: Column) -> Column:
    """A text with a number and a word: a street or box.  Remarks in the place of an address
    have no number."""
    text = F.trim(value)
    return F.coalesce(text.rlike(r"\d") & text.rlike(r"[A-Za-z]{2}"), F.lit(False))


def ranking(complete: Column, trust: Column | None, recency: str, id_col: str) -> list[Column]:
    """The order of representatives: most complete, most trusted, latest, then of the smallest id.
    NULL trust and NULL times come last."""
    trusted = [trust.desc_nulls_last()] if trust is not None else []
    return [complete.desc(), *trusted, F.col(tick(recency)).desc_nulls_last(), F.col(tick(id_col))]


def best_per_field(rows: DataFrame, group: str, id_col: str, usable: Mapping[str, Column], recency: str, trust: Column | None = None) -> DataFrame:
    """(group, field_name, best_id): per group and field the first row by ``ranking``, where a row
    is complete if its field is usable.  Groups without a usable value have no row."""
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), u.alias("usable")) for n, u in usable.items()]))
    level = trust if trust is not None else F.lit(0)
    # A row that is not complete never wins, so it need not travel.
    long = rows.select(F.col(tick(group)).alias("group"), F.col(tick(id_col)).alias("id"), F.col(tick(recency)).alias("at"), level.alias("trust"), fields.alias("f")).where("f.usable")
    first = Window.partitionBy("group", "field_name").orderBy(*ranking(F.col("f.usable").cast("int"), F.col("trust"), "at", "id"))
    ranked = long.withColumn("field_name", F.col("f.name")).withColumn("r", F.row_number().over(first)).where("r = 1")
    return ranked.select("group", "field_name", F.col("id").alias("best_id"))


def survivors(rows: DataFrame, group: str, id_col: str, usable: Mapping[str, Column], recency: str, trust: Column | None = None) -> DataFrame:
    """One record per group: the first row by ``ranking``, where a row is the more complete the more
    fields it has usable, with each field replaced by the value of ``best_per_field``.

    All columns of the row are kept; a field no row of the group can fill is NULL.
    """
    score = reduce(lambda a, b: a + b, [F.when(u, 1).otherwise(0) for u in usable.values()])
    base = rows.withColumn("_r", F.row_number().over(Window.partitionBy(tick(group)).orderBy(*ranking(score, trust, recency, id_col)))).where("_r = 1").drop("_r")
    best = best_per_field(rows, group, id_col, usable, recency, trust)
    values = rows.select(F.col(tick(id_col)).alias("_rm_best"), *[F.col(tick(n)).alias(f"_v_{n}") for n in usable])
    best = best.withColumnsRenamed({"group": "_rm_group", "best_id": "_rm_best", "field_name": "_rm_field"})
    wide = best.join(values, "_rm_best").groupBy("_rm_group").agg(*[F.max(F.when(F.col("_rm_field") == n, F.col(f"_v_{n}"))).alias(f"_b_{n}") for n in usable])
    joined = base.join(wide, F.col(tick(group)) == F.col("_rm_group"), "left")
    return joined.select(*[F.col(f"_b_{c}").alias(c) if c in usable else F.col(tick(c)) for c in rows.columns])


def _plain(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(column, F.lit("")))), r"[^\p{L}]", "")


def _id(column: Column) -> Column:
    return let(F.regexp_replace(F.upper(column), r"[^0-9A-Z]", ""), lambda t: F.nullif(t, F.lit("")))


def duplicate_groups(voters: DataFrame, block: int = 1_000) -> DataFrame:
    """(id, component): rows of one voter share a component, named by their smallest id.

    Rows are one voter's if they agree in county id or state id, however written; or in birth
    date and in first or family name, the other name and the middle initial being compatible,
    if nothing contradicts: state ids, county ids of one county, registration dates.  Names are
    compatible if equal, one slip apart, or one a short form of the other.  Rows with a birth date
    missing need equal names, county and registration date.  Dates that stand for a missing one
    count as missing.  Equal profiles are reduced before any are compared; the pairs of a birth
    date and name that many profiles share are spread over tasks (``block`` of ``grid_self_join``).
    """
    born = F.col("born_at").cast("date")
    county = F.upper(F.trim("county_code"))
    v = voters.select(
        F.col("id"),
        F.concat(county, F.lit("/"), _id(F.col("county_file_id"))).alias("ck"),
        _id(F.col("state_file_id")).alias("sk"),
        _plain(F.col("first_name")).alias("f"),
        F.substring(_plain(F.col("middle_name")), 1, 1).alias("m"),
        _plain(F.col("last_name")).alias("l"),
        F.when(~born.cast("string").isin(*sorted(STANDIN_DATES)), born).alias("b"),
        F.col("registered_at").alias("g"),
        county.alias("c"),
    ).where("id IS NOT NULL")
    v = cut(v)
    profile = ["f", "m", "l", "b", "g", "c"]
    ids = ["sk", "ck"]
    # A profile with the ids it is known by stands for all its rows, with none for those without.
    named = v.where("f <> '' AND l <> ''").groupBy(*profile, *ids).agg(F.min("id").alias("id"))
    keyed = named.select(
        "id",
        *ids,
        *profile,
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("b").isNotNull(), F.concat_ws("/", F.lit("a"), "b", "l")),
                    F.when(F.col("b").isNotNull(), F.concat_ws("/", F.lit("b"), "b", "f")),
                    F.when(F.col("g").isNotNull(), F.concat_ws("/", F.lit("c"), "g", "c", "l", "f")),
                ),
                lambda k: k.isNotNull(),
            )
        ).alias("key"),
    )
    keyed = keyed.withColumn("key", F.xxhash64("key"))
    agrees = lambda *names: reduce(lambda x, y: x & y, [F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(True)) for c in names])
    same_key = F.expr("(a.b = b.b AND (a.l = b.l OR a.f = b.f)) OR (a.g = b.g AND a.c = b.c AND a.l = b.l AND a.f = b.f)")
    middle = F.expr("a.m = b.m OR a.m = '' OR b.m = ''")
    registered = agrees("ck") | (F.col("a.c") != F.col("b.c"))
    pairs = grid_self_join(keyed, "key", "id", block).where(F.expr("a.id < b.id") & same_key & agrees("sk", "g", "b") & registered & middle & _alike("f") & _alike("l"))
    pairs = pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    linked = pairs.select(F.concat_ws("-", F.lit("p"), "a_id", "b_id").alias("key"), F.explode(F.array("a_id", "b_id")).alias("id"))
    same = v.where("f <> '' AND l <> '' AND (b IS NOT NULL OR g IS NOT NULL)").select("id", F.concat_ws("/", F.lit("e"), "f", "m", "l", F.coalesce(F.col("b").cast("string"), F.lit("-")), F.coalesce(F.col("g").cast("string"), F.lit("-")), "c", F.coalesce("sk", F.lit("-")), F.coalesce("ck", F.lit("-"))).alias("key"))
    members = v.select("id", F.concat(F.lit("k"), "ck").alias("key")).unionByName(v.select("id", F.concat(F.lit("s"), "sk").alias("key"))).unionByName(same).unionByName(linked.select("id", "key"))
    return components(members, v)


def _alike(name: str) -> Column:
    """Equal, one slip apart (two for an exchange in a longer name), or one a short form, taken
    from the beginning or the end, of the other."""
    x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
    shorter = F.least(F.length(x), F.length(y))
    slip = (F.levenshtein(x, y, 2) >= 0) & (shorter >= 4) & ((F.levenshtein(x, y, 1) >= 0) | (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))))
    short = (shorter >= 2) & (F.startswith(x, y) | F.startswith(y, x) | ((shorter >= 3) & (F.endswith(x, y) | F.endswith(y, x))))
    return (x == y) | slip | short


def groups_of(rows: DataFrame, labels: DataFrame, id_col: str = "id", name: str = "group_id", least: int = 2) -> DataFrame:
    """``rows`` of groups with at least ``least`` members, with their group; a column of the rows
    with the group's name gives way to it."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("component")
    kept = labels.join(sizes, "component").select(F.col("id").alias("_rm_id"), F.col("component").alias(name))
    return rows.drop(name).join(kept, F.col(tick(id_col)) == F.col("_rm_id")).drop("_rm_id")


__all__: Sequence[str] = ["best_per_field", "duplicate_groups", "groups_of", "ranking", "survivors", "usable_address", "usable_email", "usable_phone"]
