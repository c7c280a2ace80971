"""Trigram sets and an inverted-index nearest-neighbour join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import template, tick
from .nearest import nearest_texts


def trigrams(text: Column) -> Column:
    """The set of trigrams of ``text``: words of letters and digits in lower case, each padded
    with two blanks before and one behind.  NULL gives NULL, a text without words an empty set."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams among all trigrams of two texts; NULL if neither has any."""
    x, y = trigrams(a), trigrams(b)
    common = F.size(F.array_intersect(x, y))
    return F.try_divide(common.cast("double"), (F.size(x) + F.size(y) - common).cast("double"))


#: Size class from which texts are not short: sets of 32 trigrams.
SHORT = 5


def text_key(column: Column) -> Column:
    """A text's digest, by which it travels."""
    return F.unhex(F.md5(column))


def similar_texts(source: DataFrame, target: DataFrame, hot: int = 2_000) -> DataFrame:
    """(st, tt, sim) for every pair of distinct texts that share over half of all their trigrams.

    Both sides have ``k`` (``text_key``) and ``text``, one row per text.  With trigrams ordered from
    rare to frequent, two such sets of n trigrams share their first common one early: within the
    first ``n - ceil(n/2) + 1`` of either, and the second within one more; and their sizes differ by
    less than a factor of two.  The index holds a digest of trigram and size class, with key and
    length only.  For short texts, which are many and made of few trigrams, a trigram of more than
    ``hot`` texts is indexed together with each trigram behind it, as any pair has at least two in
    common.  Sets are fetched once per pair that is left.
    """
    sets = source.select("k", "text", F.lit(0).alias("side")).unionByName(target.select("k", "text", F.lit(1).alias("side"))).select("k", "side", trigrams(F.col("text")).alias("grams")).where(F.size("grams") > 0)
    exploded = sets.select("k", "side", F.explode("grams").alias("g"))
    counts = exploded.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    n, size = F.size("o"), F.col("n")
    first = (size - F.ceil(size / 2) + 1).cast("int")
    ordered = exploded.join(counts, "g").groupBy("k", "side").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o")).withColumn("n", n)
    level = F.floor(F.log2("n")).cast("int")
    ordered = ordered.select("k", "side", "n", F.slice("o", F.lit(1), first + 1).alias("o"), first.alias("first"), F.when(F.col("side") == 0, F.array(level - 1, level, level + 1)).otherwise(F.array(level)).alias("cs"))

    def keys(x: Column, i: Column) -> Column:
        """Index keys of the trigram at place ``i``: itself, or if it is hot one per size class the
        other set may have, and for short texts one per trigram behind it."""
        behind = lambda c: F.transform(F.slice("o", i + 2, F.size("o")), lambda y: F.xxhash64(x["g"], y["g"], c))
        split = F.flatten(F.transform("cs", lambda c: F.when(c < SHORT, behind(c)).otherwise(F.array(F.xxhash64(x["g"], c)))))
        return F.transform(F.when(x["df"] > hot, split).otherwise(F.array(F.xxhash64(x["g"]))), lambda k: F.struct(k.alias("key"), i.alias("p")))

    entries = F.flatten(F.transform(F.slice("o", F.lit(1), F.col("first")), keys))
    rows = ordered.select("k", "side", "n", F.explode(entries).alias("e"))
    a = rows.where("side = 0").select("e.key", F.col("e.p").alias("sp"), F.col("k").alias("st"), F.col("n").alias("sn"))
    b = rows.where("side = 1").select("e.key", F.col("e.p").alias("tp"), F.col("k").alias("tt"), F.col("n").alias("tn"))
    # At their first common trigram two sets can still share what stands behind it in both.
    met = a.join(b, "key").where("sn < 2 * tn AND tn < 2 * sn AND 3 * least(sn - sp, tn - tp) > sn + tn").select("st", "tt").distinct()
    grams = lambda side, k, name: sets.where(f"side = {side}").select(F.col("k").alias(k), F.col("grams").alias(name))
    both = met.join(grams(0, "st", "sg"), "st").join(grams(1, "tt", "tg"), "tt")
    both = both.select("st", "tt", F.size("sg").alias("sn"), F.size("tg").alias("tn"), F.size(F.array_intersect("sg", "tg")).alias("common")).where("3 * common > sn + tn")
    return both.select("st", "tt", (F.col("common").cast("double") / (F.col("sn") + F.col("tn") - F.col("common"))).alias("sim"))


def nearest_by_trigram(source: DataFrame, target: DataFrame, source_id: str, target_id: str, column: str, constraints: Sequence[tuple[str, str]] = (), hot: int = 2_000) -> DataFrame:
    """For each source row the most similar target row, if over half of all trigrams are shared.

    Returns ``source_id`` as ``sid`` and ``target_id`` as ``tid``; ties go to the smallest
    target id.  Texts are compared once, whatever the number of their rows; without constraints
    by ``nearest_texts``, which keeps no list of pairs.  ``constraints`` are
    (column, condition) with ``$S`` and ``$T`` for the column on either side; rows that agree in
    the text and in all that the conditions read stand for one another.
    """
    names = list(dict.fromkeys(c for c, _ in constraints))

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        text = F.col(tick(column)).cast("string")
        return df.select(F.col(tick(key)).alias(name), text.alias("text"), F.struct(F.lit(1).alias("one"), *[F.col(tick(c)) for c in names]).alias("c")).where("text IS NOT NULL").withColumn("k", text_key(F.col("text")))

    s, t = side(source, source_id, "sid"), side(target, target_id, "tid")
    if not names:
        return s.join(nearest_texts(s.select("text"), t.select("text", "tid")).withColumnRenamed("st", "k"), "k").select("sid", "tid")
    texts = lambda df: df.groupBy("k").agg(F.any_value("text").alias("text"))
    pairs = similar_texts(texts(s), texts(t), hot)
    reduced = t.groupBy(F.col("k").alias("tt"), F.col("c").alias("t")).agg(F.min("tid").alias("tid"))
    asked = s.select(F.col("k").alias("st"), F.col("c").alias("s")).distinct()
    found = pairs.join(asked, "st").join(reduced, "tt")
    for c, text in constraints:
        found = found.where(F.expr(template(text, f"s.{tick(c)}", f"t.{tick(c)}")))
    best = found.groupBy(F.col("st").alias("k"), F.col("s").alias("c")).agg(F.min(F.struct((-F.col("sim")).alias("d"), "tid"))["tid"].alias("tid"))
    rows = s.alias("x").join(best.alias("y"), (F.col("x.k") == F.col("y.k")) & F.col("x.c").eqNullSafe(F.col("y.c")))
    return rows.select("sid", "tid")
