"""Personal information in free text, by a linear-chain conditional random field.

The model reads tokens by their shape, ends and neighbours, is trained on a small labelled table
(``pii_samples``) when first needed, and decodes by Viterbi in numpy over batches of texts.  All
scores of a token depend on the token itself or a near neighbour, so they are computed once for
each distinct token of a batch and gathered.  Whole texts are decoded, as one chain each; the
weights, a few MB, are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_on_workers, spread
from ..spec import tick
from .pii_samples import labelled

KIND_NAMES = ("email", "phone", "identity_number", "street_address", "person_name")
LABELS = ("O", *(f"{p}-{k}" for k in KIND_NAMES for p in "BI"))
_INDEX = {label: i for i, label in enumerate(LABELS)}

#: Texts in the labelled table, passes over it, texts per step of training, and the ridge.
SAMPLES, EPOCHS, BATCH, RIDGE = 10_000, 5, 64, 1e-3

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
_CJK = "぀-ヿ㐀-鿿豈-﫿"
#: A token with the white space before it: a CJK sign, a run of letters, a run of digits, or a sign.
PIECE = re.compile(rf"\s*(?:[{_CJK}]|(?:(?![{_CJK}])[^\W\d_])+|\d+|\S)")


def key_of(piece: str) -> str:
    """What the model sees of a piece: its token, behind a blank if white space stands before it;
    digits are all 0, as only their number is looked at."""
    token = piece.lstrip()
    text = "0" * min(len(token), 14) if token[0].isdigit() else token
    return text if len(token) == len(piece) else " " + text


def bounds(pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a text's pieces."""
    ends = np.cumsum([len(p) for p in pieces])
    return ends - [len(p.lstrip()) for p in pieces], ends


def _shape(token: str) -> str:
    if token.isdigit():
        return f"d{len(token)}"
    if len(token) == 1 and not token.isalpha():
        return token
    if token.isupper():
        return "X" if len(token) == 1 else "XX"
    if token.islower():
        return "x"
    if token[:1].isupper() and token[1:].islower():
        return "Xx"
    return "?" if token.isalpha() else "#"


def features(key: str) -> tuple[list[str], list[str]]:
    """Of a token: features used at every offset, and features used near offset 0 only."""
    glued, token = not key.startswith(" "), key.strip()
    low = token.lower()
    shape = _shape(token)
    wide = [f"w={low}", f"s={shape}", f"g={glued}", f"sg={shape}{glued}"]
    near = []
    if low.isalpha():
        near = [f"p3={low[:3]}", f"p4={low[:4]}", f"e2={low[-2:]}", f"e3={low[-3:]}", f"e4={low[-4:]}", f"n={min(len(low), 10)}", f"le={shape}{low[-3:]}"]
    return wide, near


@dataclass(frozen=True)
class Crf:
    """Feature numbers, emission weights [feature, label], transitions [from, to], start."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def tables(self, keys: Sequence[str]) -> np.ndarray:
        """Scores [offset, key + 1, label] of what each key says of a token so far away; the
        last row, of no token, is zero."""
        out = np.zeros((len(OFFSETS), len(keys) + 1, len(LABELS)), dtype=np.float32)
        for i, key in enumerate(keys):
            wide, near = features(key)
            for o, offset in enumerate(OFFSETS):
                ids = [v for f in _named(wide, near, offset) if (v := self.vocabulary.get(f)) is not None]
                if ids:
                    out[o, i] = self.weights[ids].sum(0)
        return out


def _named(wide: list[str], near: list[str], offset: int) -> list[str]:
    return [f"{offset}|{f}" for f in (wide + near if abs(offset) <= 1 else wide)]


def _allowed() -> np.ndarray:
    """Transitions: an inside label only behind a label of its kind."""
    bad = np.zeros((len(LABELS), len(LABELS)), dtype=bool)
    for j, b in enumerate(LABELS):
        if b.startswith("I-"):
            for i, a in enumerate(LABELS):
                bad[i, j] = a[2:] != b[2:]
    return ~bad


_ALLOWED = _allowed()
#: Numbers of the labels that begin a mention of each kind, that go on in it, and that follow any label.
_BEGIN, _INSIDE = np.arange(1, len(LABELS), 2), np.arange(2, len(LABELS), 2)
_FREE = np.concatenate([[0], _BEGIN])
_NEVER = np.float32(-1e4)


def tags(text: str, spans: Sequence[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    pieces = PIECE.findall(text)
    keys, (starts, ends) = [" " + key_of(p).lstrip() if i == 0 else key_of(p) for i, p in enumerate(pieces)], bounds(pieces)
    out = [0] * len(keys)
    for a, b, kind in spans:
        first = True
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            if s < b and e > a:
                out[i] = _INDEX[("B-" if first else "I-") + kind]
                first = False
    return keys, out


@lru_cache(maxsize=2)
def train(samples: int = SAMPLES, epochs: int = EPOCHS, seed: int = 7) -> Crf:
    """Maximum likelihood with a small ridge, by Adam on batches; the same at every call."""
    data = [d for d in (tags(t, s) for t, s in labelled(samples, seed)) if d[0]]
    vocabulary: dict[str, int] = {}
    seen: dict[str, int] = {}
    cache: dict[str, tuple[list[str], list[str]]] = {}
    for keys, _ in data:
        for i in range(len(keys)):
            for offset in OFFSETS:
                if 0 <= i + offset < len(keys):
                    key = keys[i + offset]
                    wide, near = cache.setdefault(key, features(key))
                    for f in _named(wide, near, offset):
                        seen[f] = seen.get(f, 0) + 1
    for f, n in seen.items():
        if n >= 3:
            vocabulary[f] = len(vocabulary)
    numbers: dict[tuple[str, int], np.ndarray] = {}

    def ids_of(key: str, offset: int) -> np.ndarray:
        if (key, offset) not in numbers:
            numbers[key, offset] = np.array([v for f in _named(*cache[key], offset) if (v := vocabulary.get(f)) is not None], dtype=np.int32)
        return numbers[key, offset]

    rows = []
    for keys, labels in data:
        ids, counts = [], []
        for i in range(len(keys)):
            own = [ids_of(keys[i + o], o) for o in OFFSETS if 0 <= i + o < len(keys)]
            ids += own
            counts.append(sum(map(len, own)))
        rows.append((np.concatenate(ids), np.array(counts), np.array(labels)))

    n, k = len(vocabulary), len(LABELS)
    w, tr, st = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
    params = [w, tr, st]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng = np.random.default_rng(seed)
    forbid = np.where(_ALLOWED, 0.0, -1e4)
    first = np.array([0.0 if not x.startswith("I-") else -1e4 for x in LABELS])
    step, means = 0, [np.zeros_like(p) for p in params]
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = 0.05 * (1 - epoch / epochs) + 0.005
        for at in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[at : at + BATCH]]
            size, longest = len(batch), max(len(b[2]) for b in batch)
            emit, gold, mask = np.zeros((size, longest, k)), np.zeros((size, longest), dtype=int), np.zeros((size, longest), dtype=bool)
            for b, (ids, counts, labels) in enumerate(batch):
                bounds = np.concatenate([[0], np.cumsum(counts)[:-1]])
                emit[b, : len(labels)] = np.add.reduceat(w[ids], bounds, axis=0)
                gold[b, : len(labels)], mask[b, : len(labels)] = labels, True
            t = tr + forbid
            alpha = np.zeros((size, longest, k))
            alpha[:, 0] = emit[:, 0] + st + first
            for i in range(1, longest):
                nxt = _logsum(alpha[:, i - 1][:, :, None] + t[None], 1) + emit[:, i]
                alpha[:, i] = np.where(mask[:, i, None], nxt, alpha[:, i - 1])
            z = _logsum(alpha[:, -1], 1)
            beta = np.zeros((size, longest, k))
            d_tr = np.zeros((k, k))
            for i in range(longest - 2, -1, -1):
                inner = emit[:, i + 1] + beta[:, i + 1]
                nxt = _logsum(t[None] + inner[:, None, :], 2)
                beta[:, i] = np.where(mask[:, i + 1, None], nxt, 0)
                joint = np.exp(alpha[:, i][:, :, None] + t[None] + inner[:, None, :] - z[:, None, None])
                joint[~mask[:, i + 1]] = 0
                d_tr += joint.sum(0)
            prob = np.exp(alpha + beta - z[:, None, None])
            prob[~mask] = 0
            d_emit = prob
            here = np.nonzero(mask)
            d_emit[here[0], here[1], gold[here]] -= 1
            pairs = mask[:, 1:]
            np.add.at(d_tr, (gold[:, :-1][pairs], gold[:, 1:][pairs]), -1)
            d_w = np.zeros((n, k))
            ids = np.concatenate([b[0] for b in batch])
            each = np.concatenate([np.repeat(d_emit[b, : len(x[2])], x[1], axis=0) for b, x in enumerate(batch)])
            np.add.at(d_w, ids, each)
            step += 1
            for j, (p, g) in enumerate(zip(params, (d_w, d_tr, d_emit[:, 0].sum(0)), strict=True)):
                g = g / size + RIDGE * p
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                p -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
                if epoch == epochs - 1:
                    means[j] += p
    # The mean of the last pass is steadier than its last step.
    w, tr, st = (x / max(1, -(-len(rows) // BATCH)) for x in means) if epochs else params
    return Crf(vocabulary, w.astype(np.float32), np.where(_ALLOWED, tr, _NEVER).astype(np.float32), (st + first).astype(np.float32))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Scorer:
    """Scores of distinct pieces, kept from batch to batch up to a bounded number."""

    def __init__(self, model: Crf, room: int = 100_000) -> None:
        self.model, self.room = model, room
        self.reset()

    def reset(self) -> None:
        self.pieces: dict[str, int] = {}
        self.keys: dict[str, int] = {}
        self.tables = self.model.tables([])

    def numbers(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """Key numbers of each text's pieces; the tables hold a row for each afterwards."""
        if len(self.pieces) > self.room:
            self.reset()
        known, out, new = self.pieces, [], []
        for pieces in texts:
            try:
                out.append(np.array([known[p] for p in pieces], dtype=np.int32))
            except KeyError:
                for p in pieces:
                    if p not in known:
                        key = key_of(p)
                        if key not in self.keys:
                            self.keys[key] = len(self.keys)
                            new.append(key)
                        known[p] = self.keys[key]
                out.append(np.array([known[p] for p in pieces], dtype=np.int32))
        if new:
            self.tables = np.concatenate([self.tables[:, :-1], self.model.tables(new)], axis=1)
        return out


def decode(model: Crf, sequences: Sequence[np.ndarray], tables: np.ndarray, room: int = 100_000) -> list[np.ndarray]:
    """Best labels of each sequence of key numbers.

    Sequences of like length go together.  Most of a text can hold no mention: against the path
    that labels everything O, a stretch of mentions gains at most what its tokens and the best
    transitions into their labels gain, where the inside of a kind follows that kind only.  Only
    tokens in some stretch with a positive bound, and their neighbours, go through Viterbi; the
    result is that of the whole chain.
    """
    out = [np.zeros(len(s), dtype=np.int8) for s in sequences]
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
    none, pad = tables.shape[1] - 1, max(map(abs, OFFSETS))
    # Best transitions into the begin and inside of each kind, and out of any, against staying with O.
    step = model.transitions - model.transitions[0, 0]
    entry, start = step[:, _BEGIN].max(0), model.start[_BEGIN] - model.start[0]
    stay = np.maximum(step[_BEGIN, _INSIDE], step[_INSIDE, _INSIDE])
    leave = max(0.0, float(step[1:, 0].max()))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(sequences[order[stop]]) <= room:
            stop += 1
        group = order[at:stop]
        at = stop
        lengths = np.array([len(sequences[i]) for i in group])
        longest = int(lengths.max())
        ids = np.full((longest + 2 * pad, len(group)), none, dtype=np.int32)
        for r, i in enumerate(group):
            ids[pad : pad + len(sequences[i]), r] = sequences[i]
        emit = tables[0][ids[:longest]]
        for o, offset in enumerate(OFFSETS[1:], 1):
            emit += tables[o][ids[pad + offset : pad + offset + longest]]
        inside = np.arange(longest)[:, None] < lengths
        # What a token can gain over O as the first of a mention of each kind, and as a later one.
        begin = emit[:, :, _BEGIN] - emit[:, :, :1] + entry
        begin[0] += start - entry
        go_on = emit[:, :, _INSIDE] - emit[:, :, :1] + stay
        begin[~inside], go_on[~inside] = -1e6, -1e6
        # The best stretch up to each token, and from it on, that has it in a mention of each kind;
        # mentions may follow each other, but a kind goes on only in itself.
        left, right = begin.copy(), np.zeros_like(begin)
        for t in range(1, longest):
            left[t] += np.maximum(left[t - 1].max(1), 0)[:, None]
            np.maximum(left[t], left[t - 1] + go_on[t], out=left[t])
            u = longest - 1 - t
            np.maximum(right[u], go_on[u + 1] + right[u + 1], out=right[u])
            np.maximum(right[u], (begin[u + 1] + right[u + 1]).max(1)[:, None], out=right[u])
        maybe = ((left + right).max(2) + leave > -1e-3) & inside
        if not maybe.any():
            continue
        wide = maybe.copy()
        wide[1:] |= maybe[:-1]
        wide[:-1] |= maybe[1:]
        wide &= inside
        # Stretches, each from its own start; outside them everything is O.
        edge = np.diff(wide.astype(np.int8), axis=0, prepend=0, append=0)
        cols, begins = np.nonzero((edge == 1).T)
        ends = np.nonzero((edge == -1).T)[1]
        _stretches(model, emit, cols, begins, ends, lengths, out, group)
    return out


def _stretches(model: Crf, emit: np.ndarray, cols: np.ndarray, begins: np.ndarray, ends: np.ndarray, lengths: np.ndarray, out: list[np.ndarray], group: Sequence[int]) -> None:
    """Viterbi on stretches [begin, end) of columns of ``emit``, all at once by length.  A
    stretch that does not begin its text follows an O, one that does not end it goes before one."""
    size = ends - begins
    order = np.argsort(size, kind="stable")
    free, first, again = model.transitions[:, _FREE], model.transitions[_BEGIN, _INSIDE], model.transitions[_INSIDE, _INSIDE]
    for part in np.array_split(order, max(1, len(order) // 2048)):
        n, longest, every = size[part], int(size[part].max()), np.arange(len(part))
        c, b = cols[part], begins[part]
        score = np.where((b == 0)[:, None], model.start, model.transitions[0]) + emit[b, c]
        back = np.zeros((longest, len(part), len(LABELS)), dtype=np.int8)
        for t in range(1, longest):
            best = score[:, :1] + free[0]
            came = np.zeros(best.shape, dtype=np.int8)
            for j in range(1, len(LABELS)):
                path = score[:, j, None] + free[j]
                came[path > best] = j
                np.maximum(best, path, out=best)
            fresh, old = score[:, _BEGIN] + first, score[:, _INSIDE] + again
            nxt = np.empty_like(score)
            nxt[:, _FREE], nxt[:, _INSIDE] = best, np.maximum(fresh, old)
            back[t][:, _FREE], back[t][:, _INSIDE] = came, np.where(old > fresh, _INSIDE, _BEGIN)
            nxt += emit[np.minimum(b + t, len(emit) - 1), c]
            score = np.where((t < n)[:, None], nxt, score)
        after = ends[part] < lengths[c]
        now = (score + np.where(after[:, None], model.transitions[:, 0], 0)).argmax(1)
        path = np.empty((longest, len(part)), dtype=np.int8)
        for t in range(longest - 1, -1, -1):
            path[t] = now
            if t:
                now = np.where(t < n, back[t, every, now], now)
        for r in range(len(part)):
            out[group[c[r]]][b[r] : b[r] + n[r]] = path[: n[r], r]


#: Words before a name that are none of it.
_TITLE = re.compile(r"(?:(?:mr|mrs|ms|miss|dr|herr|frau|mme|mlle|señora?|sra|gruss|gruß|signed|cordialement|ref)\b[.,:]*\s+)+", re.I)


def _refine(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """An exact check of a decoded mention: signs at its ends go, and it must hold what its kind
    cannot be without."""
    while start < end and text[start] in " \t\n.,;:/\"'“”„«»<>[]–—-" or (start < end and text[start] == "(" and ")" not in text[start:end]):
        start += 1
    while end > start and (text[end - 1] in " \t\n,;:/\"'“”„«»<>[–—-" or (text[end - 1] == "." and kind in ("phone", "email", "identity_number"))):
        end -= 1
    if kind == "person_name":
        title = _TITLE.match(text, start, end)
        start = title.end() if title else start
        while start < end and not text[start].isalpha():
            start += 1
    piece = text[start:end]
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        fine = bool(re.search(r"@|\bat\b", piece, re.I)) and bool(re.search(r"[^\W\d_]", piece)) and bool(re.search(r"\.|\bdot\b", piece, re.I))
        fine = fine and not piece.startswith("@")
    elif kind == "phone":
        fine = digits >= 7
    elif kind == "identity_number":
        fine = digits >= 5
    elif kind == "street_address":
        fine = digits >= 1 and bool(re.search(r"[^\W\d_]", piece))
    else:
        words = re.findall(r"[^\W\d_]+", piece)
        fine = digits == 0 and 1 <= len(words) <= 6 and max(map(len, words)) >= 2 and piece.count(",") <= 1 and "@" not in piece
    return (start, end) if fine else None


def mentions(model: Crf | Scorer, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each mention of each text, in code points from 0."""
    scorer = model if isinstance(model, Scorer) else Scorer(model)
    cut = [PIECE.findall(" " + t) if t else [] for t in texts]  # a text begins as after a blank
    sequences = scorer.numbers(cut)
    out = []
    for text, pieces, path in zip(texts, cut, decode(scorer.model, sequences, scorer.tables), strict=True):
        found: list[tuple[int, int, str]] = []
        if path.any():
            starts, ends = bounds(pieces)
            open_at = None
            for i, label in enumerate([*path.tolist(), 0]):
                if open_at is not None and (label == 0 or label % 2 == 1):
                    kind = KIND_NAMES[(int(path[open_at]) - 1) // 2]
                    at = int(starts[open_at]) - 1
                    for line in text[at : int(ends[i - 1]) - 1].split("\n"):  # no mention runs over a line
                        spot = _refine(text, at, at + len(line), kind)
                        if spot:
                            found.append((*spot, kind))
                        at += len(line) + 1
                    open_at = None
                if label % 2 == 1:
                    open_at = i
        out.append(found)
    return out


def redact(text: str, found: Sequence[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each mention and otherwise unchanged."""
    parts, at = [], 0
    for start, end, kind in sorted(found):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None, rows: int = 4_000, redacted: bool = True) -> DataFrame:
    """One row per document: id, ``found`` (kind, start_at from 1, length) and ``redacted``.

    NULL texts come out with NULL and no mentions, empty texts empty.  Repeated rows come out as
    often as they are given.  ``rows`` texts are decoded at a time.  Without ``redacted`` that
    column is NULL and the texts do not travel back.
    """
    ensure_on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # bounded by the labelled table
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                texts = [t if isinstance(t, str) else "" for t in part["t"]]
                found = mentions(scorer, texts)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "found": [[{"pii_kind": k, "start_at": a + 1, "length": b - a} for a, b, k in f] for f in found],
                        "redacted": [redact(t, f) if redacted and isinstance(raw, str) else None for t, f, raw in zip(texts, found, part["t"], strict=True)],
                    }
                )

    picked = spread(docs).select(F.col(tick(id_col)).alias("id"), F.col(tick(text_col)).alias("t"))
    out = picked.mapInPandas(run, f"id {kind}, found array<struct<pii_kind:string,start_at:bigint,length:int>>, redacted string")
    return out.withColumnRenamed("id", id_col)
