"""The nearest text by trigrams: blocks of texts against blocks of texts, in numpy on the workers.

Texts made of the same phrases share many trigrams and have very many pairs above any bound.  Here
no pair leaves the task that meets it, only each source text's nearest in a block of the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ensure_on_workers

#: Most texts and characters of a block, and fewest texts for which blocks are cut to busy all cores.
TEXTS, CHARS, FEW = 25_000, 12_000_000, 1_000
#: Characters read into trigrams at a time; rows and columns of a product; trigrams looked up at a time.
CHUNK, ROWS, COLUMNS, LOOKUPS = 1_000_000, 512, 4_096, 2_000_000
#: Columns of the first bound, and groups of like texts that it is asked for together.
COARSE, GROUPS = 1_024, 16

Sets = tuple[np.ndarray, np.ndarray, np.ndarray]


def sets_of(texts: list[str]) -> Sets:
    """(sizes, ids, codes) of the trigram sets of ``texts``, words in lower case between single
    blanks.  ``ids`` has the sets one after the other as places in ``codes``, which are sorted; a
    code is made of a trigram's three code points, 21 bits each."""
    padded = ["  " + t.strip(" ").replace(" ", "   ") + " " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(padded)))
    # A window over the end of a word has blanks in its middle and at its end; no trigram does.
    within = (owner[:-2] == owner[2:]) & ~((points[1:-1] == 32) & (points[2:] == 32))
    codes, ids = np.unique(((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[within], return_inverse=True)
    members = np.unique(owner[:-2][within] * max(1, len(codes)) + ids)
    owner, ids = np.divmod(members, max(1, len(codes)))
    return np.bincount(owner, minlength=len(texts)), ids.astype(np.int32), codes


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``lengths`` from ``starts`` on, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def joined(parts: list[Sets]) -> tuple[np.ndarray, Sets]:
    """All ``parts`` as one, from small sets to large; the order comes with it.  Empty sets are left out."""
    codes = np.unique(np.concatenate([c for _, _, c in parts]))
    sizes = np.concatenate([n for n, _, _ in parts])
    ids = np.concatenate([np.searchsorted(codes, c).astype(np.int32)[i] for _, i, c in parts])
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    return order, (sizes[order], ids[places((np.cumsum(sizes) - sizes)[order], sizes[order])], codes)


class _Side:
    """One side of a comparison, reduced to the trigrams that both have."""

    def __init__(self, sets: Sets, shared: np.ndarray) -> None:
        self.n, ids, codes = sets
        at = np.minimum(np.searchsorted(shared, codes), max(0, len(shared) - 1))
        here = shared[at] == codes if len(shared) else np.zeros(len(codes), bool)
        keep = here[ids]
        self.ids = at.astype(np.int32)[ids[keep]]
        kept = np.bincount(np.repeat(np.arange(len(self.n)), self.n)[keep], minlength=len(self.n))
        self.at = np.concatenate([[0], np.cumsum(kept)])

    def rows(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1])), self.ids[self.at[lo] : self.at[hi]]

    def all(self, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``matrix`` of all sets, made piece by piece."""
        m, lost = np.empty((len(self.n), width + 3), np.float32), np.empty(len(self.n), np.float32)
        for lo in range(0, len(m), COLUMNS):
            m[lo : lo + COLUMNS], lost[lo : lo + COLUMNS] = self.matrix(np.arange(lo, min(lo + COLUMNS, len(m))), column, width)
        return m, lost

    def permuted(self, order: np.ndarray) -> _Side:
        other = copy(self)
        sizes = np.diff(self.at)[order]
        other.n, other.ids, other.at = self.n[order], self.ids[places(self.at[order], sizes)], np.concatenate([[0], np.cumsum(sizes)])
        return other

    def matrix(self, sets: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Membership per column with three columns to spare, and how many trigrams share a column with others of their set."""
        m = np.zeros((len(sets), width + 3), np.float32)
        sizes = self.at[sets + 1] - self.at[sets]
        m[np.repeat(np.arange(len(sets)), sizes), column[self.ids[places(self.at[sets], sizes)]]] = 1
        return m, sizes - m[:, :width].sum(1)


def like(side: _Side, column: np.ndarray, width: int) -> np.ndarray:
    """An order of sets by size class, then group of like sets; it decides on work only, not on results."""
    m = side.all(column, width)[0][:, :width]
    m /= np.maximum(1, np.linalg.norm(m, axis=1))[:, None]
    middles = m[np.unique(np.linspace(0, len(m) - 1, GROUPS).astype(int))]
    for _ in range(5):
        group = (m @ middles.T).argmax(1)
        middles = np.stack([m[group == g].mean(0) if (group == g).any() else c for g, c in enumerate(middles)])
        middles /= np.maximum(1e-9, np.linalg.norm(middles, axis=1))[:, None]
    return np.lexsort((side.n, group, np.log2(side.n).astype(int)))


def compare(source: Sets, target: Sets, rank: np.ndarray, width: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, place) of each source set's nearest target set that shares over half of all
    trigrams, by smallest ``rank`` among equals; place -1 where there is none.  Sizes are sorted.

    Products of 0/1 matrices bound the common trigrams: the frequent ones have a column each, the
    rest share columns by hash, and what a set loses there is added.  A bound of few columns leaves
    out targets too far from a whole group of like sources, one of up to ``width`` columns most
    other pairs; what reaches the best so far is counted exactly.  ``width`` changes the work only.
    """
    shared = np.intersect1d(source[2], target[2], assume_unique=True)
    s, t = _Side(source, shared), _Side(target, shared)
    if not len(shared):
        return np.zeros(len(s.n)), np.full(len(s.n), -1)
    frequency = np.bincount(s.ids, minlength=len(shared)) + np.bincount(t.ids, minlength=len(shared))
    place = np.empty(len(shared), np.int64)
    place[np.argsort(-frequency, kind="stable")] = np.arange(len(shared))

    def columns(d: int) -> np.ndarray:
        own = d if len(shared) <= d else d // 2
        return np.where(place < own, place, own + (place - own) % max(1, d - own))

    few = min(len(shared), width, COARSE)
    order = like(s, columns(few), few)
    best, hit = _nearest_in_order(s.permuted(order), t, rank, len(shared), columns, few, width)
    back = np.argsort(order)
    return best[back], hit[back]


def _nearest_in_order(s: _Side, t: _Side, rank: np.ndarray, shared: int, columns: Callable[[int], np.ndarray], few: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The comparison, with the source in an order that puts like sets side by side."""
    best, hit = np.zeros(len(s.n)), np.full(len(s.n), -1)
    height = max(16, min(ROWS, 64_000_000 // shared))
    coarse = columns(few)
    bounds, missed = t.all(coarse, few)
    bounds[:, few], bounds[:, few + 1], bounds[:, few + 2] = t.n, 1, missed / 2
    lengths = np.diff(t.at)

    def count(lo: int, row: np.ndarray, col: np.ndarray, member: np.ndarray) -> None:
        """Exact similarities of pairs; the best are kept."""
        sizes = t.at[col + 1] - t.at[col]
        found = np.concatenate([[0], np.cumsum(member[np.repeat(row, sizes), t.ids[places(t.at[col], sizes)]], dtype=np.int64)])
        ends = np.cumsum(sizes)
        common, both = found[ends] - found[ends - sizes], s.n[lo + row] + t.n[col]
        over = 3 * common > both
        row, col, sim = lo + row[over], col[over], common[over] / (both - common)[over]
        order = np.lexsort((rank[col], -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        first = np.diff(row, prepend=-1) > 0
        row, col, sim = row[first], col[first], sim[first]
        better = (sim > best[row]) | ((sim == best[row]) & (rank[col] < rank[hit[row]]))
        best[row[better]], hit[row[better]] = sim[better], col[better]

    for lo in range(0, len(s.n), height):
        hi = min(lo + height, len(s.n))
        n = s.n[lo:hi].astype(np.float64)
        middle = np.median(n)
        d = min(shared, width, 1_024 if middle < 48 else 2_048 if middle < 128 else 4_096)
        column = columns(d)
        sides = [(x, d, lost) for d, (x, lost) in ((w, s.matrix(np.arange(lo, hi), c, w)) for w, c in ((few, coarse), (d, column)))]
        member = np.zeros((hi - lo, shared), np.uint8)
        member[s.rows(lo, hi)] = 1

        def room(a: np.ndarray, d: int, lost: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The bound on common trigrams less what is needed, with room for rounding."""
            a[:, d], a[:, d + 1], a[:, d + 2] = -share, lost / 2 - share * n + 0.05 + 1e-5 * n, 1
            return a @ b.T

        # Only sizes between half and double of a set's own can share enough; nearest sizes first.
        low, high = np.searchsorted(t.n, n.min() / 2, side="right"), np.searchsorted(t.n, n.max() * 2)
        cuts = [(b, min(b + COLUMNS, high)) for b in range(low, high, COLUMNS)]
        about = np.searchsorted(t.n, middle)
        need = lambda: (lambda x: x / (1 + x))(np.maximum(best[lo:hi], 0.5))  # noqa: E731  share of both sizes that must be common
        for b0, b1 in sorted(cuts, key=lambda c: abs((c[0] + c[1]) / 2 - about)):
            share = need()
            near = b0 + np.flatnonzero(room(*sides[0], bounds[b0:b1]).max(0) > 0)
            if not len(near):
                continue
            m = t.n[near]
            b, missed = t.matrix(near, column, d)
            b[:, d], b[:, d + 1], b[:, d + 2] = m, 1, missed / 2
            left = room(*sides[1], b)
            top = left.argmax(1)
            row = np.flatnonzero(left[np.arange(hi - lo), top] > 0)
            if not len(row):
                continue
            for part in np.array_split(row, -(-int(lengths[near[top[row]]].sum()) // LOOKUPS) or 1):
                count(lo, part, near[top[part]], member)
            row, col = np.divmod(np.flatnonzero(left.ravel() > 0), len(near))
            spare = left[row, col]
            order = np.argsort(-spare, kind="stable")
            row, col, spare = row[order], col[order], spare[order]
            rest = col != top[row]
            row, col, spare = row[rest], col[rest], spare[rest]
            while len(row):
                still = spare > (need() - share)[row] * (n[row] + m[col])
                row, col, spare = row[still], col[still], spare[still]
                step = max(1, int(np.searchsorted(np.cumsum(lengths[near[col]]), LOOKUPS)))
                if len(row):
                    count(lo, row[:step], near[col[:step]], member)
                row, col, spare = row[step:], col[step:], spare[step:]
    return best, hit


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's texts as blocks, as a rule one."""
    parts: list[Sets] = []
    keys: list[pa.Array] = []
    texts = chars = 0

    def block() -> pa.RecordBatch:
        order, (sizes, ids, codes) = joined(parts)
        kept = pa.concat_arrays(keys).take(pa.array(order))
        ids = ids.astype(np.uint16) if len(codes) <= 1 << 16 else ids
        return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype(np.int32), ids, codes)), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)], names=["sizes", "ids", "codes", "keys"])

    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
            size = int(ends[to - 1]) - before
            if parts and (texts + to - at > TEXTS or chars + size > CHARS):
                yield block()
                parts, keys, texts, chars = [], [], 0, 0
            parts.append(sets_of(batch["text"].slice(at, to - at).to_pylist()))
            keys.append(batch["key"].slice(at, to - at))
            texts, chars, at = texts + to - at, chars + size, to
    if parts:
        yield block()


def _unpacked(sizes: pa.Scalar, ids: pa.Scalar, codes: pa.Scalar) -> Sets:
    n, c, i = np.frombuffer(sizes.as_py(), np.int32).astype(np.int64), np.frombuffer(codes.as_py(), np.int64), ids.as_py()
    return n, np.frombuffer(i, np.uint16 if len(c) <= 1 << 16 else np.int32).astype(np.int32), c


def _nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks the nearest target of each source text."""
    for batch in batches:
        for r in range(batch.num_rows):
            sets = [_unpacked(*(batch[f"{side}{x}"][r] for x in ("sizes", "ids", "codes"))) for side in "st"]
            asked, keys = batch["skeys"][r].values, batch["tkeys"][r].values
            rank = np.empty(len(keys), np.int64)
            rank[pc.array_sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(keys))
            best, hit = compare(*sets, rank)
            row = np.flatnonzero(hit >= 0)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(row)), pa.array(best[row]), keys.take(pa.array(hit[row]))], names=["st", "sim", "tid"])


def nearest_texts(source: DataFrame, target: DataFrame) -> DataFrame:
    """(st, tid) for each distinct ``text`` of ``source`` that has a text in ``target`` with over half
    of all trigrams in common: its digest, and the smallest ``tid`` of the most similar texts.

    Every source text meets every target text whose set is between half and double its size, in a
    grid of blocks read from the shared folder.  Shuffled are the texts, once, and one row per
    source text and block of the target.
    """
    spark = source.sparkSession
    ensure_on_workers(spark)

    def extent(df: DataFrame) -> tuple[int, int]:
        """Distinct texts and their characters."""
        one = df.groupBy(F.xxhash64("text")).agg(F.max(F.length("text")).alias("n"))
        return tuple(one.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first())

    texts, parts = zip(*[(n, max(1, -(-n * 5 // (TEXTS * 4)), -(-chars * 5 // (CHARS * 4)))) for n, chars in (extent(source), extent(target))])
    parts, cores = list(parts), spark.sparkContext.defaultParallelism
    while parts[0] * parts[1] < 2 * cores and max(per := [n // p for n, p in zip(texts, parts)]) >= 2 * FEW:
        parts[per.index(max(per))] += 1

    def blocks(df: DataFrame, n: int, kind: T.DataType, side: str) -> DataFrame:
        words = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
        schema = T.StructType([*(T.StructField(x, T.BinaryType()) for x in ("sizes", "ids", "codes")), T.StructField("keys", T.ArrayType(kind))])
        packed = cut(df.repartition(n).select(words.alias("text"), "key").mapInArrow(_pack, schema))
        return packed.select(*[F.col(c).alias(side + c) for c in packed.columns])

    kind = target.schema["tid"].dataType
    s = blocks(source.select("text").distinct().select("text", F.unhex(F.md5("text")).alias("key")), parts[0], T.BinaryType(), "s")
    t = blocks(target.groupBy("text").agg(F.min("tid").alias("key")), parts[1], kind, "t")
    found = s.hint("shuffle_replicate_nl").crossJoin(t).mapInArrow(_nearest, T.StructType([T.StructField("st", T.BinaryType()), T.StructField("sim", T.DoubleType()), T.StructField("tid", kind)]))
    return found.groupBy("st").agg(F.min(F.struct((-F.col("sim")).alias("d"), "tid"))["tid"].alias("tid"))
