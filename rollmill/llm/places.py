"""Which address records denote the same place.

Records are read into components once, on the workers, and reduced to distinct *forms* before
anything is compared, so copies never meet.  Localities come first: slips in town names are mended
and a missing town follows from the postcode.  Then every form is indexed in its blocks: its
locality, every postcode that more than one locality uses, and the neighbouring locality best known
in such a postcode.  Inside a block the index holds the strings that deleting one letter of a street
word, or of the whole street, leaves (both themselves included): forms that share an entry differ by
about one slip or share a word, in whatever order.  House or box number and unit are in the index
key, so a difference in either is a veto.  For each candidate pair the words of town and street are
assigned to each other at least cost; directions, road numbers and types must not disagree, and a
direction or type that one lacks is taken from the others where these have only one.  Each form then
follows the best supported form it agrees with, and records whose forms end at the same one denote
the same place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut, ensure_on_workers
from .postal import near, read_address, squeeze

_PARTS = "kind string, number string, direction string, street string, type string, unit string, place string"


def read_records(records: DataFrame, id_col: str, line: str, more: str | None, town: str, zip_code: str, area: str) -> DataFrame:
    """(id, area, town, zip, and the components of the address); texts in lower case."""
    ensure_on_workers(records.sparkSession)
    picked = records.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(line).cast("string"), F.lit("")).alias("line"),
        F.coalesce(F.col(more).cast("string"), F.lit("")).alias("more") if more else F.lit("").alias("more"),
        F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(town), F.lit("")), r"\s+", " "))).alias("town"),
        F.regexp_extract(F.coalesce(F.col(zip_code), F.lit("")), r"^\s*(\d{5})", 1).alias("zip"),
        F.lower(F.trim(F.coalesce(F.col(area), F.lit("")))).alias("area"),
    ).where("id IS NOT NULL")
    kind = dict(picked.dtypes)["id"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_address(a, b) for a, b in zip(batch["line"], batch["more"], strict=True)]
            out = batch[["id", "area", "town", "zip"]].copy()
            for name in ("kind", "number", "direction", "street", "type", "unit", "place"):
                out[name] = [getattr(x, name) for x in found]
            out["town"] = [t or squeeze(x.place) for t, x in zip(out["town"], found, strict=True)]
            yield out

    return picked.mapInPandas(read, f"id {kind}, area string, town string, zip string, {_PARTS}")


def deletions(text: Column) -> Column:
    """``text`` without blanks, and the same with each single letter left out."""
    bare = F.regexp_replace(text, " ", "")
    cuts = F.transform(F.sequence(F.lit(1), F.length(bare)), lambda i: F.concat(F.substring(bare, F.lit(1), i - 1), F.substring(bare, i + 1, F.length(bare))))
    return F.when(F.length(bare) == 0, F.array(F.lit(""))).otherwise(F.array_union(F.array(bare), cuts))


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x.replace(" ", ""), y.replace(" ", "")) for x, y in zip(a, b, strict=True)])


def mended(words: DataFrame, block: str, word: str) -> DataFrame:
    """(block, word, fixed) for the words that are a slip of a better known word of their block.

    A word is taken for a slip of another one letter away if that is eight times as frequent
    over all blocks, or if it occurs no more than twice itself and the other is more frequent.
    """
    counts = words.where(F.length(word) >= 4).groupBy(F.col(block).alias("block"), F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.withColumn("all", F.sum("n").over(Window.partitionBy("word")))
    index = cut(known.select("block", "word", "all", F.explode(deletions(F.col("word"))).alias("key")))
    better = "b.all >= 8 * a.all OR (a.all <= 2 AND b.all > a.all)"
    met = index.alias("a").join(index.alias("b"), ["block", "key"]).where(f"a.word <> b.word AND ({better})")
    pairs = met.select("block", F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.all").alias("m")).distinct()
    pairs = pairs.where(_near("word", "other"))
    return pairs.groupBy("block", "word").agg(F.max(F.struct("m", "other"))["other"].alias("fixed"))


def settle_localities(read: DataFrame) -> DataFrame:
    """``read`` with ``locality``: the mended town; without one, the town that most records of
    the postcode name; else the postcode, else the area itself."""
    named = read.where("town <> ''")
    fixes = mended(named, "area", "town").select(F.col("block").alias("area"), F.col("word").alias("town"), "fixed")
    towns = read.join(fixes, ["area", "town"], "left").withColumn("town", F.coalesce("fixed", "town")).drop("fixed")
    votes = towns.where("town <> ''").groupBy("zip", "area", "town").agg(F.count(F.lit(1)).alias("n"))
    by_zip = votes.where("zip <> ''").groupBy("zip", "town").agg(F.sum("n").alias("n")).groupBy("zip").agg(F.max(F.struct("n", "town"))["town"].alias("zip_town"))
    shares = votes.groupBy("area", "town").agg(F.sum("n").alias("n")).groupBy("area").agg(F.max(F.struct("n", "town")).alias("b"), F.sum("n").alias("s"))
    by_area = shares.where("b.n >= 0.95 * s").select("area", F.col("b.town").alias("area_town"))
    out = towns.join(by_zip, "zip", "left").join(by_area, "area", "left")
    place = F.coalesce(F.nullif("town", F.lit("")), "zip_town", F.when(F.col("zip") == "", F.col("area_town")), F.concat(F.lit("zip "), F.nullif("zip", F.lit(""))), F.concat(F.lit("area "), F.col("area")))
    return out.withColumn("locality", place).drop("zip_town", "area_town")


def mend_streets(read: DataFrame) -> DataFrame:
    """``read`` with slips in street words mended against the words of the locality.

    Fixes join to the words of distinct streets by locality and word, so nothing of a large town
    travels as a whole."""
    streets = read.where("street <> '' AND type <> 'cr'")
    words = streets.select("locality", F.explode(F.split("street", " ")).alias("word"))
    fixes = mended(words, "locality", "word").select(F.col("block").alias("locality"), "word", "fixed")
    each = streets.select("locality", "street").distinct().select("locality", "street", F.posexplode(F.split("street", " ")).alias("at", "word"))
    new = each.join(fixes, ["locality", "word"], "left").groupBy("locality", "street").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", "word").alias("w")))).alias("l"), F.max("fixed").alias("any"))
    new = new.where("any IS NOT NULL").select("locality", "street", F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("mended"))
    out = read.join(new, ["locality", "street"], "left")
    return out.withColumn("street", F.when(F.col("type") != "cr", F.coalesce("mended", "street")).otherwise(F.col("street"))).drop("mended")


_NO = 10**6


def least_assignment(cost: Sequence[Sequence[int]]) -> int:
    """Least total cost of assigning rows to columns one to one, for a square matrix, by the
    Hungarian method (cubic in its size)."""
    n = len(cost)
    u, v, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, seen, before = [_NO * (n + 1)] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while owner[at]:
            seen[at] = True
            row, delta, nxt = owner[at], _NO * (n + 1), 0
            for j in range(1, n + 1):
                if not seen[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < least[j]:
                        least[j], before[j] = c, at
                    if least[j] < delta:
                        delta, nxt = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = nxt
        while at:
            owner[at], at = owner[before[at]], before[at]
    return sum(cost[owner[j] - 1][j - 1] for j in range(1, n + 1))


def assignment(a: str, b: str) -> int | None:
    """Least number of slips that turn the words of one street into the other's, each word
    assigned to one of the other's; None if words remain or differ by more than one slip."""
    if a == b or a.replace(" ", "") == b.replace(" ", ""):
        return 0
    if [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return None  # a road's number is part of its name, never a slip
    x, y = a.split(), b.split()
    if len(x) == len(y):
        slip = lambda p, q: 1 if near(p, q) and not any(c.isdigit() for c in p + q) else _NO
        cost = least_assignment([[0 if p == q else slip(p, q) for q in y] for p in x])
        if cost < _NO:
            return cost
    return 1 if near(a.replace(" ", ""), b.replace(" ", "")) else None


@F.pandas_udf(T.IntegerType())
def _assignment(a: pd.Series, b: pd.Series, town_a: pd.Series, town_b: pd.Series) -> pd.Series:
    """Slips in street and town together; None if either cannot be assigned."""
    out = []
    for x, y, p, q in zip(a, b, town_a, town_b, strict=True):
        street = assignment(x, y)
        town = 0 if p == q else assignment(p, q)
        out.append(None if street is None or town is None else street + town)
    return pd.Series(out, dtype="Int32")


FORM = ["locality", "kind", "number", "unit", "direction", "street", "type"]


def places(records: DataFrame, id_col: str, line: str, more: str | None, town: str, zip_code: str, area: str) -> DataFrame:
    """(id, place): equal places are the same building or unit.

    Records without street or box, or without a number, denote no place we could compare and
    are left out.  Columns may be NULL; repeated ids come out once per row.
    """
    read = cut(read_records(records, id_col, line, more, town, zip_code, area))
    settled = cut(settle_localities(read).where("kind <> '' AND number <> ''").select("id", "zip", *FORM))
    rows = cut(mend_streets(settled))
    counted = rows.groupBy(*FORM).agg(F.count(F.lit(1)).alias("n"))
    over = lambda *names: F.sum("n").over(Window.partitionBy(*names))
    street = ["locality", "direction", "street"]
    forms = counted.withColumn("support", over(*street, "type")).withColumn("common", over(*street)).withColumn("form", F.concat_ws("|", *FORM))

    # The index travels as one hash per entry; what it stands for is compared after the join.
    veto = F.concat_ws("|", "kind", "number", "unit")
    words = F.flatten(F.transform(F.split("street", " "), deletions))
    keys = F.array_union(deletions(F.col("street")), words)
    entries = cut(_blocks(forms, rows)).withColumn("veto", veto).withColumn("keys", F.transform(keys, lambda k: F.xxhash64("block", "veto", k)))
    index = entries.select(F.explode("keys").alias("key"), "form", "veto", "locality", "street", "type", "direction", "support", "common")
    # Both sides are one and the same exchange; columns get their sides' names behind it.
    agree = "a.veto = b.veto AND (a.type = b.type OR a.type = '' OR b.type = '') AND (a.direction = b.direction OR a.direction = '' OR b.direction = '')"
    met = index.alias("a").join(index.alias("b"), F.col("a.key") == F.col("b.key")).where(f"a.form <> b.form AND {agree}")
    sides = [F.col(f"{x}.{c}").alias(f"{n}{x}") for x in "ab" for c, n in (("locality", "l"), ("street", "s"), ("type", "t"), ("direction", "d"), ("support", "n"), ("common", "c"))]
    pairs = met.select(F.col("a.form").alias("form"), F.col("b.form").alias("other"), *sides).dropDuplicates(["form", "other"])
    pairs = cut(pairs.withColumn("cost", _assignment("sa", "sb", "la", "lb")).where("cost IS NOT NULL"))
    # A missing type or direction is settled if all candidates have one.  A street written without
    # direction eight times as often as with it has none, and the record with one lies elsewhere.
    only = lambda own, other: F.when(F.max(own) != "", F.max(own)).when(F.count_distinct(F.when(F.col(other) != "", F.col(other))) == 1, F.max(other)).otherwise("")
    lacking = F.max((F.col("da") == "") & (F.col("db") != "") & (F.col("ca") < 8 * F.col("cb")))
    settled = cut(pairs.groupBy("form").agg(only("ta", "tb").alias("t"), F.when((F.max("da") != "") | lacking, only("da", "db")).otherwise("").alias("d")))
    pairs = pairs.join(settled, "form").join(settled.select(F.col("form").alias("other"), F.col("t").alias("t_b"), F.col("d").alias("d_b")), "other").where("t = t_b AND d = d_b")
    # A form follows a better known one: with a type or direction it lacks, then of more support.
    whole = lambda x: (F.col(f"t{x}") != "").cast("int") + (F.col(f"d{x}") != "").cast("int")
    up = pairs.withColumn("more", whole("b") - whole("a")).where("more > 0 OR (more = 0 AND (nb > na OR (nb = na AND other < form)))")
    follows = up.groupBy("form").agg(F.min(F.struct((-F.col("more")).alias("m"), "cost", (-F.col("nb")).alias("n"), "other"))["other"].alias("to"))
    ends = _ends(follows)
    keyed = rows.withColumn("form", F.concat_ws("|", *FORM)).select("id", "form")
    return keyed.join(ends, "form", "left").select("id", F.coalesce("to", "form").alias("place"))


def _blocks(forms: DataFrame, rows: DataFrame) -> DataFrame:
    """Forms with the blocks they are compared in; a form that is alone with its number and unit in
    a block has nothing to be compared with there and is left out.

    A postcode that only one locality uses would hold no pair which the locality's own block lacks."""
    used = rows.where("zip <> ''").groupBy("zip", "locality").agg(F.count(F.lit(1)).alias("n"))
    shared = used.groupBy("zip").agg(F.max(F.struct("n", "locality"))["locality"].alias("best"), F.count(F.lit(1)).alias("localities")).where("localities > 1")
    there = rows.where("zip <> ''").select("zip", *FORM).distinct().join(shared, "zip")
    more = there.select(*FORM, F.explode(F.array(F.concat(F.lit("zip "), F.col("zip")), F.col("best"))).alias("block")).where("block <> locality").distinct()
    attributes = [c for c in forms.columns if c not in FORM]
    extra = more.join(forms, FORM).select(*FORM, *attributes, "block")
    entries = forms.select(*FORM, *attributes, F.col("locality").alias("block")).unionByName(extra)
    alone = Window.partitionBy("block", "kind", "number", "unit")
    return entries.withColumn("_m", F.count(F.lit(1)).over(alone)).where("_m > 1").drop("_m")


def _ends(follows: DataFrame) -> DataFrame:
    """Each form's last leader.  Leaders rise strictly, so chains end; each round doubles the
    steps taken, and a round that changes nothing is the last."""
    now = cut(follows)
    while True:
        nxt = now.select(F.col("form").alias("_f"), F.col("to").alias("_t"))
        step = now.join(nxt, F.col("to") == F.col("_f"), "left")
        later = cut(step.select("form", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("moved")))
        if later.where("moved").isEmpty():
            return later.select("form", "to")
        now = later.select("form", "to")


def same_place_pairs(found: DataFrame) -> DataFrame:
    """(low, high) for every two records of one place."""
    once = found.select("place", "id").distinct()
    a, b = once.select("place", F.col("id").alias("low")), once.select("place", F.col("id").alias("high"))
    return a.join(b, "place").where("low < high").select("low", "high")
