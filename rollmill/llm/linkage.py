"""Probabilistic record linkage of two tables without a shared key.

Both tables are brought to common attributes on the workers.  Several blocking passes, each an
equality join on a key that few records share, propose candidate pairs; every pair is compared
attribute by attribute on a few levels of agreement.  The counts of level patterns, whose number
the levels bound, go to the driver, where expectation-maximisation estimates how often matches and
several kinds of non-matches show each level; for identifiers, how often non-matches do comes from
random pairs, and pairs that agree on one show how matches look.
The posterior probability of a match is the pair's confidence, and
each record of the second table takes the pair of highest confidence.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ensure_on_workers
from .blocks import grid_join
from .people import county_digits, id_core, plain, read_date, split_name
from .postal import read_address

ATTRIBUTES = "f string, m string, l string, born string, ck string, sk string, cc string, number string, street string, unit string, g string"

#: Levels per comparison; level 0 is "cannot be compared" and says nothing.
LEVELS = {"last": 5, "first": 6, "middle": 3, "born": 5, "county": 4, "state": 4, "address": 5, "gender": 3}

#: Comparisons of identifiers.  Candidates that agree on one are nearly all matches, so how often
#: different people do is not estimated from candidates but from random pairs.
IDENTIFIERS = ("county", "state")


def _row(first: str, middle: str, last: str, born: str, county_id: str | None, state_id: str | None, county: str | None, line: str | None, more: str | None, gender: str | None) -> tuple:
    a = read_address(line, more)
    street = " ".join(x for x in (a.direction, a.street, a.type) if x) if a.kind == "street" else a.kind
    core = id_core(state_id)
    core = core[2:] if core[:2].isalpha() else core
    sex = (gender or "").strip().upper()[:1]
    number = a.number if a.kind else ""
    return first, middle[:1], last, born, county_digits(county_id), core, (county or "").strip().upper(), number, street if number else "", a.unit if number else "", sex if sex in ("F", "M") else ""


def read_voters(voters: DataFrame) -> DataFrame:
    """(id, attributes) of a voter table."""
    cols = ["id", "first_name", "middle_name", "last_name", "born_at", "county_file_id", "state_file_id", "county_code", "residential_address1", "residential_address2", "gender"]
    picked = voters.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("string").alias(c) for c in cols[1:]]).where("id IS NOT NULL")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, *_row(plain(f).replace(" ", ""), plain(m), plain(n).replace(" ", ""), read_date(d), c, s, cc, a1, a2, g))
                for i, f, m, n, d, c, s, cc, a1, a2, g in zip(*(b[c] for c in cols), strict=True)
            ]
            yield pd.DataFrame(rows, columns=["id", *_NAMES])

    return picked.mapInPandas(read, f"id bigint, {ATTRIBUTES}")


_NAMES = [c.split()[0] for c in ATTRIBUTES.split(", ")]


def read_rows(roll: DataFrame) -> DataFrame:
    """(id, attributes, other) of a roll with whole names: the likelier reading of the name, and in
    ``other`` the names of the second one, NULL where there is none."""
    cols = ["id", "full_name", "born_at", "county_file_id", "state_file_id", "county_code", "residential_address1", "gender"]
    picked = roll.select(F.col("roll_id").cast("bigint").alias("id"), *[F.col(c).cast("string").alias(c) for c in cols[1:]]).where("id IS NOT NULL")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, d, c, s, cc, a1, g in zip(*(b[c] for c in cols), strict=True):
                (first, middle, last), *more = split_name(n) or [("", "", "")]
                f2, m2, l2 = more[0] if more else (None, None, None)
                rows.append((i, *_row(first, middle, last, read_date(d), c, s, cc, a1, None, g), f2, m2 and m2[:1], l2))
            yield pd.DataFrame(rows, columns=["id", *_NAMES, "f2", "m2", "l2"])

    out = picked.mapInPandas(read, f"id bigint, {ATTRIBUTES}, f2 string, m2 string, l2 string")
    other = F.when(F.col("l2").isNotNull(), F.struct(F.col("f2").alias("f"), F.col("m2").alias("m"), F.col("l2").alias("l")))
    return out.select("id", *_NAMES, other.alias("other"))


def readings(rows: DataFrame) -> DataFrame:
    """One row per way to read a name, numbered in ``reading``."""
    kept = [c for c in rows.columns if c not in ("f", "m", "l", "other")]
    names = F.filter(F.array(F.struct("f", "m", "l"), F.col("other")), lambda x: x.isNotNull())
    return rows.select(*kept, F.posexplode(names).alias("reading", "name")).select(*kept, "reading", "name.*")


def read_roll(roll: DataFrame) -> DataFrame:
    """(id, reading, attributes) of a roll with whole names: one row per way to read a name."""
    return readings(read_rows(roll)).select("id", "reading", *_NAMES)


def blocking_keys() -> Column:
    """The keys of a record, one per pass; passes whose attributes are missing give none."""
    full = F.length("born") == 10
    initial, stem = F.substring("f", 1, 1), F.substring("l", 1, 3)
    has = lambda *names: F.expr(" AND ".join(f"{n} <> ''" for n in names))
    key = lambda tag, *parts: F.concat_ws("/", F.lit(tag), *parts)
    return F.filter(
        F.array(
            F.when(F.length("sk") >= 5, key("s", _bare("sk"))),
            F.when(F.length("ck") >= 4, key("c", F.col("cc"), _bare("ck"))),
            F.when(full & has("l"), key("bl", F.col("born"), stem)),
            F.when(full & has("f"), key("bf", F.col("born"), initial, F.col("cc"))),
            F.when(has("l", "f"), key("n", F.col("cc"), F.col("l"), initial)),
            F.when(has("l", "f", "born"), key("y", F.substring("born", 1, 4), F.soundex("l"), F.substring("f", 1, 2))),
            F.when(has("number", "street", "f"), key("a", F.col("cc"), F.col("number"), F.col("street"), initial)),
            F.when(has("number", "l"), key("al", F.col("cc"), F.col("number"), stem, F.col("unit"))),
        ),
        lambda k: k.isNotNull(),
    )


def _bare(name: str | Column) -> Column:
    """An identifier without leading zeros, which some sources drop."""
    return F.ltrim(F.col(name) if isinstance(name, str) else name, F.lit("0"))


def _slip(x: Column, y: Column) -> Column:
    """One letter apart, or two letters exchanged."""
    return (F.levenshtein(x, y, 1) >= 0) | ((F.levenshtein(x, y, 2) >= 0) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))))


def comparisons(other: str = "b") -> dict[str, Column]:
    """Level of each comparison between the sides ``a`` and ``other`` of a pair; 1 is best."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"{other}.{n}"))

    def level(name: str, *steps: Column) -> Column:
        out = F.when((a(name) == "") | (b(name) == ""), 0)
        for i, step in enumerate(steps, 1):
            out = out.when(step, i)
        return out.otherwise(len(steps) + 1).cast("int")

    part = lambda n, at, size: F.substring(n, at, size)
    x, y = a("born"), b("born")
    one_part = ((part(x, 1, 4) == part(y, 1, 4)).cast("int") + (part(x, 6, 2) == part(y, 6, 2)).cast("int") + (part(x, 9, 2) == part(y, 9, 2)).cast("int")) == 2
    swapped = (part(x, 1, 4) == part(y, 1, 4)) & (part(x, 6, 2) == part(y, 9, 2)) & (part(x, 9, 2) == part(y, 6, 2))
    # Days miscounted by a few, or a year off by the calendar.
    days = F.abs(F.datediff(x.try_cast("date"), y.try_cast("date")))
    shifted = F.coalesce((days <= 10) | days.isin(365, 366), F.lit(False))
    both = (F.length(x) == 10) & (F.length(y) == 10)
    short = lambda p, q: (F.length(p) >= 2) & (F.length(q) >= 2) & (F.startswith(p, q) | F.startswith(q, p) | (F.endswith(p, q) & (F.length(q) >= 3)) | (F.endswith(q, p) & (F.length(p) >= 3)))
    # Cut off in front (its zeros gone too) or behind, or two letters off.
    within = lambda p, q: ((F.length(q) >= 4) & F.startswith(p, q)) | ((F.length(_bare(q)) >= 4) & F.endswith(p, _bare(q))) | (F.levenshtein(p, q, 2) >= 0)
    same_house = a("number") == b("number")
    same_street = (a("street") == b("street")) | (F.levenshtein(a("street"), b("street"), 2) >= 0) | (F.length(b("street")) >= 4) & (F.startswith(a("street"), b("street")) | F.startswith(b("street"), a("street")))
    return {
        "last": level("l", a("l") == b("l"), _slip(a("l"), b("l")), (F.soundex(a("l")) == F.soundex(b("l"))) | short(a("l"), b("l"))),
        "first": level("f", a("f") == b("f"), _slip(a("f"), b("f")) & (F.least(F.length(a("f")), F.length(b("f"))) >= 3) | short(a("f"), b("f")), (part(a("f"), 1, 1) == part(b("f"), 1, 1)) & (F.least(F.length(a("f")), F.length(b("f"))) == 1), part(a("f"), 1, 1) == part(b("f"), 1, 1)),
        "middle": level("m", a("m") == b("m")),
        "born": level("born", x == y, both & (one_part | swapped | shifted), (part(x, 1, 4) == part(y, 1, 4))),
        "county": level("ck", (_bare(a("ck")) == _bare(b("ck"))) & (a("cc") == b("cc")), within(a("ck"), b("ck"))),
        "state": level("sk", _bare(a("sk")) == _bare(b("sk")), within(a("sk"), b("sk"))),
        "address": level("street", same_house & same_street & (a("unit") == b("unit")), same_house & same_street, same_house | (a("street") == b("street"))),
        "gender": level("g", a("g") == b("g")),
    }


#: Kinds of candidates that are different people, and the comparisons that they start to share.
#: Their shares among candidates shift with the size of the tables: namesakes grow as the product
#: of both sides, matches as one of them.  The last kind is only of pairs that agree on an
#: identifier: numbers may be given out or written down twice.
OTHERS = (("address",), ("born",), ("last", "first"), IDENTIFIERS)


def best_levels() -> list[Column]:
    """The comparisons of a pair, names by the reading that agrees better: of a match the other one
    would look like a pair of different names."""
    one = comparisons()
    two = {k: c for k, c in comparisons("b.other").items() if k in ("last", "first", "middle")}
    better = F.col("b.other").isNotNull() & (two["last"] + two["first"] < one["last"] + one["first"])
    return [(F.when(better, two[k]).otherwise(c) if k in two else c).alias(k) for k, c in one.items()]


@dataclass(frozen=True)
class Model:
    """Share of matches among candidates; share of each kind of non-matches among these; and per
    comparison the log ratio of how often matches and non-matches of that kind show each level."""

    prior: float
    shares: tuple[float, ...]
    kinds: tuple[Mapping[str, tuple[float, ...]], ...]
    weights: Mapping[str, tuple[float, ...]]

    def posterior(self) -> Column:
        against = F.lit(0.0)
        for kind, share, weights in zip(OTHERS, self.shares, self.kinds, strict=True):
            log_odds = F.lit(float(np.log(self.prior / (1 - self.prior)) - np.log(share)))
            for name, w in weights.items():
                log_odds = log_odds + F.get(F.array(*[F.lit(float(x)) for x in w]), F.col(name))
            agreed = F.greatest(*[(F.col(k) == 1) for k in IDENTIFIERS]) if kind == IDENTIFIERS else F.lit(True)
            against = against + F.when(agreed, F.exp(-log_odds)).otherwise(0.0)
        return 1 / (1 + against)


def fit(patterns: pd.DataFrame, known: Mapping[str, tuple[float, ...]], rounds: int = 500, tolerance: float = 1e-7, anchors: int = 30) -> Model:
    """Expectation-maximisation over counted patterns (one column per comparison, and ``n``).

    Comparisons are taken as independent given the class, which is a match or a kind of
    non-matches; a missing level weighs nothing.  ``known`` has how often non-matches show each
    level of the identifiers, which stays as given.  How often matches show the levels of a
    comparison is learnt from candidates that agree on an identifier (another one, if it is one
    itself), if ``anchors`` or more of these are matches: namesakes outnumber matches in large
    tables, and without that hold the class of matches turns into that of equal names.  Without
    patterns the model has a prior of one half and no weights.
    """
    names = list(LEVELS)
    n = patterns["n"].to_numpy(float)
    if not len(n):
        none = {k: (0.0,) * LEVELS[k] for k in names}
        return Model(0.5, (1 / len(OTHERS),) * len(OTHERS), (none,) * len(OTHERS), none)
    at = {k: patterns[k].to_numpy(int) for k in names}
    hot = np.hstack([np.eye(LEVELS[k])[at[k]] for k in names])
    cut_at = np.cumsum([LEVELS[k] for k in names])[:-1]
    agreed = np.any([at[k] == 1 for k in known], axis=0)
    anchor = {k: np.any([at[x] == 1 for x in known if x != k], axis=0) for k in names}

    def shown(weight: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for k, c in zip(names, np.split(weight @ hot, cut_at), strict=True):
            out[k] = np.concatenate([[0.0], (c[1:] + 0.5) / (c[1:] + 0.5).sum()])
        return out

    def matches(weight: np.ndarray) -> dict[str, np.ndarray]:
        sets = {a.tobytes(): shown(weight * a) for a in anchor.values() if (weight * a).sum() >= anchors}
        every = shown(weight)
        return {k: sets.get(anchor[k].tobytes(), every)[k] for k in names}

    def start(k: str) -> np.ndarray:
        share = np.array([0.85 * 0.3**i for i in range(LEVELS[k] - 1)])
        return np.concatenate([[0.0], share / share.sum()])

    m = {k: x if (n * anchor[k]).sum() >= anchors else start(k) for k, x in matches(n).items()}
    # Non-matches start as the mirror image of matches, but for what their kind shares.
    given = [{k for k in known if k not in kind} for kind in OTHERS]
    u = [{k: np.array(known[k]) if k in given[i] else start(k) if k in kind else np.concatenate([[0.0], start(k)[:0:-1]]) for k in names} for i, kind in enumerate(OTHERS)]
    mix = np.array([0.5, *(0.5 / len(OTHERS),) * len(OTHERS)])
    for _ in range(rounds):
        logs = np.stack([np.concatenate([[0.0, *np.log(share[k][1:])] for k in names]) for share in (m, *u)], axis=1)
        g = hot @ logs + np.log(mix)
        g[~agreed, -1] = -np.inf
        g = np.exp(g - g.max(1, keepdims=True))
        g = g / g.sum(1, keepdims=True) * n[:, None]
        new = np.clip(g.sum(0) / n.sum(), 1e-9, 1)
        new /= new.sum()
        m = matches(g[:, 0])
        u = [{k: old[k] if k in given[i] else x for k, x in shown(g[:, i + 1]).items()} for i, old in enumerate(u)]
        done = np.abs(new - mix).max() < tolerance
        mix = new
        if done:
            break
    prior = float(np.clip(mix[0], 1e-9, 1 - 1e-9))
    others = mix[1:] / mix[1:].sum()

    def weights(other: Mapping[str, np.ndarray]) -> dict[str, tuple[float, ...]]:
        # A worse level never speaks more for a match than a better one.
        return {k: (0.0, *np.minimum.accumulate(np.log(m[k][1:]) - np.log(other[k][1:]))) for k in names}

    return Model(prior, tuple(map(float, others)), tuple(map(weights, u)), weights({k: sum(s * x[k] for s, x in zip(others, u, strict=True)) for k in names}))


def candidates(a: DataFrame, b: DataFrame, block: int = 1_000) -> DataFrame:
    """Distinct (a_id, profile) that share a key of some blocking pass, every pair of a key.

    ``block`` is that of ``grid_join``, which spreads the pairs of hot keys over tasks.
    """
    # Keys travel as 64-bit hashes: a collision proposes a pair more, which comparison turns down.
    keyed = lambda df, name: df.select(name, F.explode(blocking_keys()).alias("k")).select(name, F.xxhash64("k").alias("key"))
    return grid_join(keyed(a.withColumnRenamed("id", "a_id"), "a_id"), keyed(b, "profile"), "key", "a_id", "profile", block).select("a_id", "profile").distinct()


def chance(a: DataFrame, b: DataFrame, draws: int = 5) -> dict[str, tuple[float, ...]]:
    """How often different people show each level of an identifier, from random pairs.

    Every record of ``b`` meets about ``draws`` records of ``a``, drawn by hash: both sides fall into
    as many buckets as that takes, so the work grows with the tables and no bucket is hot.  Pairs
    that agree in birth date, or in both names, may be matches and do not count.  Half a pair is
    added to every level, so a level that never occurs is as rare as the draws can tell.
    """
    buckets = max(1, -(-a.count() // draws))
    need = ("l", "f", "born", "ck", "sk", "cc")
    side = lambda df, key, name: df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.struct(*need).alias(name))
    drawn = side(a, "id", "a").join(side(b, "profile", "b"), "bucket")
    apart = F.expr("NOT (a.born <> '' AND a.born = b.born) AND NOT (a.l <> '' AND a.l = b.l AND a.f = b.f)")
    steps = comparisons()
    counted = drawn.where(apart).groupBy(*[steps[k].alias(k) for k in IDENTIFIERS]).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most one row per combination of levels
    out = {}
    for k in IDENTIFIERS:
        n = np.bincount(counted[k].to_numpy(int), counted["n"].to_numpy(float), LEVELS[k])[1:] + 0.5
        out[k] = (0.0, *(n / n.sum()))
    return out


def link(voters: DataFrame, roll: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(voter_id, roll_id, confidence): for each roll row the voter row of highest confidence,
    if that reaches the threshold; ties go to the smallest voter id.

    A voter may have several roll rows.  Rows without an id are left out; attributes may all be
    missing, such rows find no one.  Either table may be empty.
    """
    ensure_on_workers(voters.sparkSession)
    # Rows equal in all that is compared are compared once: voters stand for their smallest id,
    # roll rows for their profile.
    a = cut(read_voters(voters).groupBy(*_NAMES).agg(F.min("id").alias("id")))
    whole = F.concat_ws("\u0001", *_NAMES, F.coalesce(F.to_json("other"), F.lit("")))
    rows = cut(read_rows(roll).withColumn("profile", F.unhex(F.md5(whole))))
    b = cut(rows.groupBy("profile", *_NAMES, "other").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    pairs = candidates(a, readings(b)).join(a.select(F.col("id").alias("a_id"), F.struct(*_NAMES).alias("a")), "a_id")
    pairs = pairs.join(b.select("profile", F.struct(*_NAMES, "other").alias("b")), "profile")
    levels = cut(pairs.select("a_id", "profile", *best_levels()))
    counted = levels.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n")).toPandas()  # bounded by the product of the levels
    model = fit(counted, chance(a, b))
    scored = levels.select("a_id", "profile", model.posterior().alias("confidence")).where(F.col("confidence") >= threshold)
    best = scored.groupBy("profile").agg(F.max(F.struct("confidence", (-F.col("a_id")).alias("minus"))).alias("m"))
    each = rows.select("id", "profile").join(best, "profile")
    return each.select((-F.col("m.minus")).alias("voter_id"), F.col("id").alias("roll_id"), F.col("m.confidence").alias("confidence"))
