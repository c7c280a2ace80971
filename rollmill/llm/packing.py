"""Filling containers of fixed capacity with items of varying length.

Only the histogram of lengths, at most one number per length up to the capacity, reaches the
driver.  There a packing of *lengths* is made: patterns of a few lengths that fill a container
are enumerated, how often to repeat each is fitted to the histogram by non-negative least
squares, rounded down, and what is left fills remaining gaps and then new containers, largest
first.  A packing is a list of (lengths, times) whose size depends on the capacity, not on the
number of items.  Items are then ranked within their length, in parallel, and rank and length
give each its container.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, ensure_on_workers

#: Least-squares steps that are tried: length classes per capacity, and lengths per pattern.
TRIALS = ((256, 2), (128, 3))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by the active-set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if active.all() or w.max() <= 1e-8 * max(1.0, np.abs(b).max()):
            break
        active[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min() > 0:
                break
            low = active & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def patterns(classes: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of up to ``most`` class numbers that fill ``classes`` exactly, or as nearly as
    classes of whole width can."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], rest: int) -> None:
        if prefix and rest == 0:
            out.append(prefix)
            return
        if len(prefix) == most:
            return
        for c in range(min(rest, prefix[-1] if prefix else rest), 0, -1):
            grow((*prefix, c), rest - c)

    grow((), classes)
    return out


@dataclass
class Packing:
    """Container kinds as (lengths, times), in the order in which containers are numbered."""

    capacity: int
    kinds: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(times for _, times in self.kinds)


def pack_histogram(histogram: Mapping[int, int], capacity: int) -> Packing:
    """A packing that holds every item of the histogram (length from 1 to the capacity).

    Of the trials the packing of fewest containers is taken.  Packing everything as residue, in
    order of length, stands beside them, as it wins where items are short.
    """
    trials = [_packed(histogram, capacity, classes, most) for classes, most in (*TRIALS, (0, 0))]
    return min(trials, key=lambda p: p.containers)


def _packed(histogram: Mapping[int, int], capacity: int, classes: int, most: int) -> Packing:
    left = {int(s): int(n) for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("lengths must be from 1 to the capacity")
    kinds: list[tuple[list[int], int]] = []
    width = -(-capacity // max(min(classes, capacity), 1))
    classes = capacity // width if most else 0
    # Class c holds lengths of up to c widths, so that classes that fit never overflow.
    of = lambda s: -(-s // width)
    held = np.zeros(classes + 2)
    for s, n in left.items():
        if of(s) <= classes:
            held[of(s)] += n
    shapes = patterns(classes, most) if most else []
    if shapes and held.sum():
        a = np.zeros((classes + 2, len(shapes)))
        for j, shape in enumerate(shapes):
            for c in shape:
                a[c, j] += 1
        # Long items matter: short ones fill gaps anyway.
        weight = np.sqrt(np.arange(classes + 2) / max(classes, 1))
        scale = held.max()
        times = np.floor(nnls(a * weight[:, None], held / scale * weight) * scale + 1e-9).astype(int)
        by_class: dict[int, list[int]] = {}
        for s in sorted(left):
            by_class.setdefault(of(s), []).append(s)
        for j in np.argsort([-sum(c * c for c in shape) for shape in shapes], kind="stable"):
            todo = int(times[j])
            while todo > 0:
                taken: dict[int, int] = {}
                lengths = []
                for c in shapes[j]:
                    found = next((s for s in reversed(by_class.get(c, [])) if left.get(s, 0) > taken.get(s, 0)), None)
                    if found is None:
                        break
                    lengths.append(found)
                    taken[found] = taken.get(found, 0) + 1
                if len(lengths) < len(shapes[j]):
                    break
                run = min(todo, *(left[s] // m for s, m in taken.items()))
                for s, m in taken.items():
                    left[s] -= run * m
                kinds.append((lengths, run))
                todo -= run
    left = {s: n for s, n in left.items() if n > 0}
    kinds = _fill(kinds, left, capacity)
    while left:
        lengths, gap, sizes = [], capacity, sorted(left)
        taken: dict[int, int] = {}
        while True:
            at = bisect_right(sizes, gap)
            if not at:
                break
            s = sizes[at - 1]
            m = min(left[s], gap // s)
            lengths += [s] * m
            taken[s] = m
            gap -= s * m
            sizes = sizes[: at - 1]
        run = min(left[s] // m for s, m in taken.items())
        for s, m in taken.items():
            left[s] -= run * m
            if not left[s]:
                del left[s]
        kinds.append((lengths, run))
    return Packing(capacity, [(tuple(sorted(lengths, reverse=True)), times) for lengths, times in kinds])


def _fill(kinds: list[tuple[list[int], int]], left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Containers with what is left put into their gaps, the largest item that fits first.
    Kinds are split where an item runs out; ``left`` is used up in place."""
    out, todo = [], sorted(kinds, key=lambda k: sum(k[0]) - capacity)
    sizes = sorted(left)
    stack = todo[::-1]
    while stack:
        lengths, times = stack.pop()
        at = bisect_right(sizes, capacity - sum(lengths))
        if not at:
            out.append((lengths, times))
            continue
        s = sizes[at - 1]
        run = min(times, left[s])
        left[s] -= run
        if not left[s]:
            del left[s]
            sizes.pop(at - 1)
        stack.append(([*lengths, s], run))
        if times > run:
            stack.append((lengths, times - run))
    return out


def slots(packing: Packing) -> pd.DataFrame:
    """For each length, runs of ranks: (size, first rank, first container, items per container)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in packing.kinds:
        for s in dict.fromkeys(lengths):
            m = lengths.count(s)
            rows.append((s, used.get(s, 0), base, m))
            used[s] = used.get(s, 0) + m * times
        base += times
    return pd.DataFrame(rows, columns=["size", "first", "container", "per"])


def pack(items: DataFrame, capacities: Mapping[str, int], id_col: str, size_col: str, buckets: int | None = None) -> DataFrame:
    """Every item's pieces with their containers, for each named capacity:
    pack_name, container_id, id, piece, token_from, n_tokens.

    An item is never split unless it alone exceeds the capacity; it is then cut into full
    containers and a rest, which is packed like an item.  Items of size 0 take no room and go to
    container 0.  Repeated ids are packed as rows of their own.  No items give no rows.  Items of
    one length are ranked in ``buckets`` parts, four times the shuffle partitions unless given.
    """
    spark = items.sparkSession
    ensure_on_workers(spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {str(k): int(v) for k, v in capacities.items()}
    sized = cut(items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("int").alias("size")))
    caps = F.explode(F.array(*[F.struct(F.lit(k).alias("pack_name"), F.lit(v).alias("capacity")) for k, v in named.items()]))
    each = sized.withColumn("c", caps).select("c.pack_name", "c.capacity", "id", "size")
    whole = F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int")
    each = each.withColumn("whole", whole).withColumn("rest", F.col("size") - F.col("whole") * F.col("capacity"))
    packed = each.where("rest > 0").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))

    counts = cut(packed.groupBy("pack_name", "rest", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = counts.groupBy("pack_name", "rest").agg(F.sum("n").alias("n")).collect()  # one row per length, at most the capacity
    tables, width = {}, 1 << 40
    for k, capacity in named.items():
        table = slots(pack_histogram({r["rest"]: r["n"] for r in histogram if r["pack_name"] == k}, capacity)).sort_values(["size", "first"])
        tables[k] = (table["size"].to_numpy(np.int64) * width + table["first"].to_numpy(np.int64), table["first"].to_numpy(np.int64), table["container"].to_numpy(np.int64), table["per"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(tables)  # bounded by the patterns of a capacity

    before = Window.partitionBy("pack_name", "rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("pack_name", "rest", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    local = Window.partitionBy("pack_name", "rest", "bucket").orderBy("id")
    ranked = packed.withColumn("r", F.row_number().over(local) - 1).join(shifts, ["pack_name", "rest", "bucket"]).withColumn("rank", F.col("r") + F.col("shift"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            container = np.zeros(len(batch), dtype=np.int64)
            for k in batch["pack_name"].unique():
                keys, first, base, per = shared.value[k]
                here = (batch["pack_name"] == k).to_numpy()
                rank = batch["rank"].to_numpy(np.int64)[here]
                at = np.searchsorted(keys, batch["rest"].to_numpy(np.int64)[here] * width + rank, side="right") - 1
                container[here] = base[at] + (rank - first[at]) // per[at]
            yield batch.assign(container=container)[["pack_name", "capacity", "id", "whole", "rest", "container"]]

    kind = dict(items.dtypes)[id_col]
    placed = ranked.select("pack_name", "capacity", "id", "whole", "rest", "rank").mapInPandas(place, f"pack_name string, capacity int, id {kind}, whole int, rest int, container bigint")
    name = lambda *parts: F.concat(F.col("pack_name"), *parts)
    rests = placed.select("pack_name", name(F.lit("-"), F.col("container").cast("string")).alias("container_id"), "id", F.col("whole").alias("piece"), (F.col("whole") * F.col("capacity")).alias("token_from"), F.col("rest").alias("n_tokens"))
    cuts = each.where("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    cuts = cuts.select("pack_name", name(F.lit("-whole-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"), "id", "piece", (F.col("piece") * F.col("capacity")).alias("token_from"), F.col("capacity").alias("n_tokens"))
    void = each.where("size <= 0").select("pack_name", name(F.lit("-0")).alias("container_id"), "id", F.lit(0).alias("piece"), F.lit(0).alias("token_from"), F.lit(0).alias("n_tokens"))
    return rests.unionByName(cuts).unionByName(void).withColumnRenamed("id", id_col)
