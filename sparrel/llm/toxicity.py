"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a fixed and of a learned lexicon (also of obfuscated spellings), how near second-person words stand to lexicon words, rates of
capitals, punctuation and obfuscation.  The learned lexicon holds words and word beginnings that toxic rows have and others don't, chosen greedily until
every toxic row is covered several times.

Lexicon, trees and calibration are fitted on a bounded sample of labelled rows, max_train_rows; of rows that share a doc_id the smallest text counts.  Rows
with crc32(doc_id) mod 5 = 0 are never learned from; those with 1 only calibrate (without both kinds among them the learned rows do).  Null texts
count as empty; without learned rows of both kinds every score is the share of toxic ones (0 if there is none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN_ROWS = 20_000
#: Candidates for the learned lexicon, its size, and how often each toxic row is to be covered.
MAX_CANDIDATES, MAX_LEXICON, COVER = 4_000, 200, 4
STEMS = (4, 5, 6)
NEAR_WORDS = 5
# General English insults, and second-person words of a few languages.
INSULTS = frozenset("idiot idiots moron morons loser losers scum trash clown clowns stupid dumb pathetic worthless disgusting fool jerk garbage vermin ugly hate".split())
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros vuestro".split())
_WORDS = re.compile(r"\w+")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_RUNS = re.compile(r"[!?]{2,}")
_SYMBOLS = re.compile(r"[^\w\s]")
_OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$*]+[^\W\d_]+[\w@$*]*")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": None})
N_FEATURES = 15


def units(word: str) -> list[str]:
    """A word and its beginnings, marked by a star, as lexicon entries."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)] if len(word) > 2 else []


class Lexicon(dict):
    """Whether a word is in it, remembered."""

    def __init__(self, entries: frozenset[str]) -> None:
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = any(u in self.entries for u in (*units(word), f"{word}*"))
        return found

    def __reduce__(self):
        return Lexicon, (self.entries,)


def features(text: str, fixed: Lexicon, learned: Lexicon) -> list[float]:
    low = text.lower()
    words = _WORDS.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    a = [i for i, hit in enumerate(map(fixed.__getitem__, words)) if hit]
    b = [i for i, hit in enumerate(map(learned.__getitem__, words)) if hit]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if second and (a or b):
        at = np.array(second)
        hits = np.array(sorted({*a, *b}))
        k = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(hits - at[np.minimum(k, len(at) - 1)]), np.abs(hits - at[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR_WORDS).sum())
    obfuscated = _OBFUSCATED.findall(low)
    disguised = sum(fixed[w] or learned[w] for w in (o.translate(_PLAIN) for o in obfuscated))
    return [
        np.log1p(len(words)), np.log1p(len(a)), len(a) / n, np.log1p(len(b)), len(b) / n, np.log1p(disguised), near / n, len(second) / n, len(obfuscated) / n,
        len(_CAPITALS.findall(text)) / chars, len(_SHOUTED.findall(text)) / n, text.count("!") / n, text.count("?") / n, len(_RUNS.findall(text)) / n, len(_SYMBOLS.findall(text)) / chars,
    ]


class Trees:
    """Gradient-boosted regression trees on log odds; splits at quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.concatenate((np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1]), [c.min()], np.quantile(c[c > c.min()], (0.05, 0.25, 0.5)) if (c > c.min()).any() else []))) for c in x.T]
        binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)  # bin k: values up to cut k
        width = max(len(c) for c in cuts) + 1
        p = y.mean()
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, cuts, width, y - q, q * (1 - q))
            self.trees.append(tree)
            f += self._value(tree, x)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], width: int, g: np.ndarray, h: np.ndarray) -> tuple:
        """A complete tree: feature and cut of each inner node (feature -1: all go left), value of each leaf."""
        inner = (1 << self.depth) - 1
        feature, cut, node = np.full(inner, -1), np.zeros(inner), np.zeros(len(g), int)
        for level in range(self.depth):
            for k in range((1 << level) - 1, (2 << level) - 1):
                own = np.flatnonzero(node == k)
                best, split = 1e-6, None
                if len(own) > 1:
                    base = g[own].sum() ** 2 / (h[own].sum() + self.ridge)
                    for j, c in enumerate(cuts):
                        gl = np.bincount(binned[own, j], g[own], width).cumsum()[: len(c)]
                        hl = np.bincount(binned[own, j], h[own], width).cumsum()[: len(c)]
                        gr, hr = g[own].sum() - gl, h[own].sum() - hl
                        gain = np.where((hl > 0.05 * self.least) & (hr > 0.05 * self.least), gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - base, 0)
                        if len(gain) and gain.max() > best:
                            best, split = float(gain.max()), (j, int(gain.argmax()))
                if split:
                    feature[k], cut[k] = split[0], cuts[split[0]][split[1]]
                    node[own] = 2 * k + 1 + (binned[own, split[0]] > split[1])
                else:
                    node[own] = 2 * k + 1
        leaf = node - inner
        return feature, cut, self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)

    def _value(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]))
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending x with non-decreasing means of y; equal x are pooled first."""
    xs, at = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # last x, sum, weight
    for v, s, w in zip(xs, np.bincount(at, y), np.bincount(at), strict=True):
        blocks.append([v, s, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    lexicon: frozenset[str] = frozenset()
    trees: Trees = field(default_factory=Trees)
    knots: tuple[np.ndarray, np.ndarray] | None = None
    share: float = 0.0

    def __post_init__(self) -> None:
        self.fixed, self.learned = Lexicon(INSULTS), Lexicon(self.lexicon)

    def features(self, texts: list[str | None]) -> np.ndarray:
        return np.array([features(t or "", self.fixed, self.learned) for t in texts], float).reshape(-1, N_FEATURES)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.trees.trees:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(self.features(texts))
        return np.interp(raw, *self.knots) if self.knots is not None else 1 / (1 + np.exp(-raw))


def _units_of(text: str) -> set[str]:
    return {u for w in set(_WORDS.findall(text.lower())) for u in units(w)}


def learn_lexicon(rows: DataFrame, max_candidates: int = MAX_CANDIDATES, max_lexicon: int = MAX_LEXICON) -> frozenset[str]:
    """Entries from rows (text, toxic): precise ones, chosen greedily to cover each toxic row COVER times."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in common.slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(_units_of(text))
        for found in (list(seen[1]), [u for u in seen[0] if u not in seen[1]]):
            yield pa.RecordBatch.from_pydict({"unit": pa.array(found, pa.string()), "pos": pa.array([seen[1][u] for u in found], pa.int64()), "neg": pa.array([seen[0][u] for u in found], pa.int64())})

    rows = rows.select("text", F.col("toxic").cast("int"))
    sums = common.map_arrow(rows, counted, "unit string, pos bigint, neg bigint").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    fit = sums.where((F.col("pos") >= 3) & (F.col("pos") >= 20 * F.col("neg")))
    candidates = [r[0] for r in fit.orderBy(F.desc("pos"), "neg", F.desc(F.length(F.rtrim(F.lit("*"), F.col("unit")))), "unit").limit(max_candidates).collect()]
    place = {u: k for k, u in enumerate(candidates)}

    def present(batch: pa.RecordBatch) -> list:
        return [[sorted(place[u] for u in _units_of(t) if u in place) for t in batch.column(0).to_pylist()]]

    has = common.mapped(rows.where("toxic = 1").select("text"), present, "units array<int>").toArrow().column("units").combine_chunks()
    return frozenset(candidates[k] for k in covering(candidates, has.offsets.to_numpy(), has.values.to_numpy(), max_lexicon))


def covering(candidates: list[str], starts: np.ndarray, units: np.ndarray, most: int = MAX_LEXICON) -> list[int]:
    """Candidates chosen one by one, each the one that most rows have that aren't covered COVER times yet; row k has units[starts[k] : starts[k + 1]].

    What a chosen one's other forms have doesn't count again.  Of equal gains the first is taken, so the more frequent and then the longer entry."""
    n, size = len(starts) - 1, len(candidates)
    of = np.repeat(np.arange(n), np.diff(starts))
    units = units[starts[0] : starts[-1]]
    order = np.argsort(units, kind="stable")
    bounds, rows = np.searchsorted(units[order], np.arange(size + 1)), of[order]
    covered, alive, gain, chosen = np.zeros(n, int), np.ones(size, bool), np.bincount(units, minlength=size), []
    least = max(3, n // 400)
    while size and len(chosen) < most:
        best = int(np.where(alive, gain, -1).argmax())
        if not alive[best] or gain[best] < least:
            break
        chosen.append(best)
        has = rows[bounds[best] : bounds[best + 1]]
        covered[has] += 1
        done = np.zeros(n, bool)
        done[has[covered[has] == COVER]] = True
        gain = gain - np.bincount(units[done[of]], minlength=size)
        own = candidates[best].rstrip("*")
        alive &= ~np.array([own.startswith(b := u.rstrip("*")) or b.startswith(own) for u in candidates])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0/1; null labels are left out, of conflicting ones the larger counts)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", common.fold_of(F.col("doc_id"))).where("fold <> 0")
    n, scale = known.count(), 1 << 30
    taken = known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(scale)) < min(scale, scale * max_train_rows // max(1, n))).limit(2 * max_train_rows)
    # At most twice max_train_rows rows of 20 bytes, so small enough to send to every task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    rows = common.written(rows.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text")), "toxicity-rows")
    learning = rows.where("fold <> 1")
    kinds = {r[0]: r[1] for r in learning.groupBy("toxic").count().collect()}
    model = Model(share=kinds.get(1, 0) / max(1, sum(kinds.values())))
    if len(kinds) < 2:
        return model
    model = Model(learn_lexicon(learning), share=model.share)

    def featurized(batch: pa.RecordBatch) -> list:
        return [batch.column(0), batch.column(2), batch.column(3), list(model.features(batch.column(1).to_pylist()))]

    table = common.mapped(rows.select("doc_id", "text", "toxic", "fold"), featurized, "doc_id bigint, toxic int, fold bigint, x array<double>").toArrow().sort_by("doc_id")
    x, y, fold = np.array(table.column("x").to_pylist()).reshape(-1, N_FEATURES), table.column("toxic").to_numpy(), table.column("fold").to_numpy()
    own = fold != 1
    model.trees.fit(x[own], y[own].astype(float))
    held = ~own if 0 < y[~own].sum() < (~own).sum() else own
    model.knots = isotonic(model.trees.raw(x[held]), y[held].astype(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null doc_ids give a null held_out; repeated rows give repeated rows."""

    def rows(batch: pa.RecordBatch) -> list:
        s = model.score(batch.column(1).to_pylist())
        return [batch.column(0), batch.column(2), s, (s >= 0.5).astype(int)]

    doc_id = F.col("doc_id").cast("long")
    return common.mapped(docs.select(doc_id.alias("doc_id"), "text", (common.fold_of(doc_id) == 0).alias("held_out")), rows, "doc_id bigint, held_out boolean, score double, predicted int")
