"""Toxicity scores from a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two tokens counts the subsequences of three letters that they share, each weighted by
DECAY to the power of the letters it spans, up to SPAN of them; so a token with letters inserted, left
out or set apart by dots still resembles its plain form. Characters that are neither letter nor digit
widen a span and are otherwise no part of it. Kernels are divided by the norms of both tokens, and
values under LEAST count as none. Landmarks are tokens of the labelled texts that mark toxic ones best
and don't resemble each other too much. The kernel of two sentences is the sum of the kernels of their
distinct tokens, so a sentence has, for each landmark, the sum over its tokens; beside each kernel counts
a power of it, a kernel too, which tells a token from one that lacks a letter; the Nyström map turns these
into the features of a linear machine with squared hinge loss. Sentences of clean texts are its negatives, sentences of toxic texts with any resemblance to a
landmark its positives. A text scores as its most toxic sentence, turned into a probability by a
logistic curve fitted to the labelled texts. Landmarks with characters put between their letters are
further positives.

Fitting takes at most SAMPLE labelled rows of each class, those with the smallest hashes of their
identifiers, of longer texts a stretch of LONGEST characters from a place by hash and of a repeated identifier one
text, and is done on the driver; scoring runs in the executors over whole texts.

Defined results: null, empty and wordless texts get the score of a sentence without any resemblance;
labels that are null are left out, and an identifier with several labels counts as toxic if one says
so; without labels of both classes every score is 0; repeated rows are scored alike; a column of docs with
the name of the score is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

DECAY, SPAN, LEAST = 0.8, 6, 0.45
LANDMARKS, ALIKE = 96, 0.8
#: A power of the kernel that counts beside it: it tells a token from another that lacks a letter.
SHARP = 4
#: Standard errors by which a landmark's shares of toxic and clean texts differ at least.
CLEAR = 5.0
#: Labelled rows of each class that are fitted at most.
SAMPLE = 2_500
#: Characters of a text that is fitted, at most; scoring reads whole texts of any length.
LONGEST = 100_000
#: Texts whose tokens are held at once while fitting.
PART = 200
#: Longest piece of a token that is compared as a whole; longer tokens are cut into overlapping pieces.
PIECE = 24

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_STEPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def tokens_of(text: str) -> list[str]:
    """Whitespace-separated tokens in lower case, and letters spelled out one by one put together."""
    low = text.lower()
    return low.split() + ["".join(x.split()) for x in _SPACED.findall(low)]


def pieces(token: str) -> list[str]:
    token = token.strip(".,;:!?\"'()[]{}|")
    return [token] if len(token) <= PIECE else [token[i : i + PIECE] for i in range(0, len(token) - PIECE // 2, PIECE // 2)]


def features(token: str) -> dict[str, float]:
    """Weights of the three-letter subsequences of a token."""
    out: dict[str, float] = defaultdict(float)
    n = len(token)
    plain = [c.isalnum() for c in token]
    for a, b in _STEPS:
        for i in range(n - a - b):
            if plain[i] and plain[i + a] and plain[i + a + b]:
                out[token[i] + token[i + a] + token[i + a + b]] += DECAY ** (a + b + 1)
    return out


def _norm(f: dict[str, float]) -> float:
    return sum(v * v for v in f.values()) ** 0.5


def kernel(x: str, y: str) -> float:
    """The normalised kernel of two tokens."""
    a, b = features(x), features(y)
    both = _norm(a) * _norm(b)
    return sum(v * b[u] for u, v in a.items() if u in b) / both if both else 0.0


def _both(kernels: np.ndarray) -> np.ndarray:
    """The kernels and their SHARP-th powers, which are a kernel as well."""
    return np.concatenate([kernels, kernels**SHARP], axis=-1)


class Landmarks:
    """Kernels of many tokens with all landmarks.

    A bound from arrays, the same for all tokens of one width, leaves few tokens to be measured one by one.
    """

    def __init__(self, names: list[str]):
        self.names = names
        maps = [features(x) for x in names]
        norms = [_norm(f) or 1.0 for f in maps]
        letters = sorted({c for f in maps for u in f for c in u})
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        self.base = len(letters) + 1
        self.columns: dict[str, list[tuple[int, float]]] = defaultdict(list)
        top = np.zeros(self.base**3, np.float32)
        for j, (f, norm) in enumerate(zip(maps, norms, strict=True)):
            for u, v in f.items():
                self.columns[u].append((j, v / norm))
                k = (self.code[u[0]] * self.base + self.code[u[1]]) * self.base + self.code[u[2]]
                top[k] = max(top[k], v / norm)
        self.top = top
        self.table = np.zeros(0x3000, np.int64)
        self.other = np.zeros(0x3000, bool)
        for point in range(0x3000):
            c = chr(point)
            self.table[point] = self.code.get(c, 0)
            self.other[point] = c.isalnum()

    def _hopeful(self, tokens: list[str], width: int) -> np.ndarray:
        """Whether the bound lets a token have a kernel of LEAST with any landmark."""
        points = np.array(tokens, f"U{width}").view(np.uint32).reshape(len(tokens), width)
        points = np.minimum(points, 0x2FFF)
        code, plain = self.table[points], self.other[points]
        reach, norm = np.zeros(len(tokens), np.float32), np.zeros(len(tokens), np.float32)
        for a, b in _STEPS:
            end = a + b
            if end >= width:
                continue
            weight = np.float32(DECAY ** (end + 1))
            x, y, z = code[:, : width - end], code[:, a : width - b], code[:, end:]
            # letters that no landmark has are 0, and so is the table at any code with one of them
            k = np.where((x > 0) & (y > 0) & (z > 0), (x * self.base + y) * self.base + z, 0)
            reach += weight * self.top[k].sum(axis=1)
            norm += weight**2 * (plain[:, : width - end] & plain[:, a : width - b] & plain[:, end:]).sum(axis=1)
        # a norm is at least that of subsequences that are all different
        return reach >= LEAST * np.sqrt(norm) - 1e-4

    def measure(self, token: str) -> np.ndarray | None:
        """Kernels with all landmarks, largest over the token's pieces; None if all are under LEAST."""
        best = np.zeros(len(self.names))
        for piece in pieces(token):
            f = features(piece)
            row = np.zeros(len(self.names))
            for u, v in f.items():
                for j, w in self.columns.get(u, ()):
                    row[j] += v * w
            if norm := _norm(f):
                np.maximum(best, row / norm, out=best)
        best[best < LEAST] = 0.0
        return best if best.any() else None

    def measure_all(self, tokens: Iterable[str]) -> dict[str, np.ndarray]:
        """The tokens that resemble a landmark, with their kernels."""
        by_width: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for token in tokens:
            for piece in pieces(token):
                if len(piece) >= 3:
                    by_width[8 if len(piece) <= 8 else 14 if len(piece) <= 14 else PIECE].append((token, piece))
        found: set[str] = set()
        for width, pairs in by_width.items():
            for at in range(0, len(pairs), 20_000):
                part = pairs[at : at + 20_000]
                found.update(part[i][0] for i in np.flatnonzero(self._hopeful([p for _, p in part], width)))
        return {t: k for t in found if (k := self.measure(t)) is not None}


class Scorer:
    """A fitted model; ``known`` remembers tokens within a task, up to a bound."""

    def __init__(self, landmarks: Landmarks, map_: np.ndarray, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.landmarks, self.direct, self.offset, self.slope, self.shift = landmarks, map_ @ weights, offset, slope, shift
        self.seen: set[str] = set()
        self.hot: dict[str, np.ndarray] = {}

    def _learn(self, lists: list[list[str]]) -> None:
        if len(self.seen) > 600_000:
            self.seen, self.hot = set(), {}
        fresh = set().union(*lists) - self.seen if lists else set()
        self.hot.update(self.landmarks.measure_all(fresh))
        self.seen |= fresh

    def margins(self, texts: list[str | None], fresh: bool = True) -> np.ndarray:
        """The largest margin of any sentence, for each text; fresh: there may be tokens not measured yet."""
        lists = [tokens_of(t) if t else [] for t in texts]
        if fresh:
            self._learn(lists)
        out = np.full(len(texts), self.offset)
        for i, tokens in enumerate(lists):
            if hot := self.hot.keys() & set(tokens):
                rows = sentence_rows(texts[i], hot, self.hot)
                out[i] = max(out[i], max((float(r @ self.direct) for r in rows), default=0.0) + self.offset)
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def sentence_rows(text: str, hot: set[str], kernels: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each sentence with tokens of ``hot`` the sums of kernels and of their powers with each landmark."""
    rows = []
    for sentence in _SENTENCE.split(text):
        if found := hot & set(tokens_of(sentence)):
            rows.append(_both(np.array([kernels[t] for t in sorted(found)])).sum(axis=0))
    return rows


def bag(text: str | None) -> set[str]:
    return {p for t in tokens_of(text or "") for p in pieces(t)}


def choose_landmarks(positive: list[str], negative: list[str], most: int = LANDMARKS) -> list[str]:
    """Tokens whose share of toxic texts exceeds their share of clean ones the most, unlike each other.

    Texts are counted one by one, and of clean ones only what toxic ones have, so that counts are all that is held.
    """
    pos: Counter = Counter()
    for text in positive:
        pos.update(bag(text))
    pos = Counter({t: n for t, n in pos.items() if n >= 3 and len(t) >= 4})
    neg: Counter = Counter()
    for text in negative:
        neg.update(t for t in bag(text) if t in pos)
    n, m = len(positive), len(negative)

    def gain(t: str) -> float:
        p, q, both = pos[t] / n, neg[t] / m, (pos[t] + neg[t]) / (n + m)
        return (p - q) / ((both * (1 - both) * (1 / n + 1 / m)) ** 0.5 or 1.0)

    ranked = sorted((t for t in pos if pos[t] / n > 8 * (neg[t] + 0.5) / m and gain(t) > CLEAR), key=lambda t: (-gain(t), t))
    chosen: dict[str, dict[str, float]] = {}
    for t in ranked[: 20 * most]:
        f = features(t)
        norm = _norm(f)
        f = {u: v / norm for u, v in f.items()}
        if all(sum(v * g[u] for u, v in f.items() if u in g) < ALIKE for g in chosen.values()):
            chosen[t] = f
            if len(chosen) == most:
                break
    return list(chosen)


def disguises(token: str) -> list[str]:
    """The token with characters put between its letters."""
    inner = range(1, len(token))
    return [c.join(token) for c in ".-*"] + [token[:i] + c + token[i:] for c in "x1" for i in inner]


def _machine(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, cost: float = 100.0) -> tuple[np.ndarray, float]:
    """Weights and offset with the least squared hinge loss, by Newton steps over the rows inside the margin."""
    full = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(full.shape[1])
    ridge = np.eye(full.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        inside = label * (full @ w) < 1
        part = full[inside] * (cost * weight[inside])[:, None]
        new = np.linalg.solve(ridge + part.T @ full[inside], part.T @ label[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _curve(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins, with a little ridge."""
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (label - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[str], toxic: list[int]) -> Scorer | None:
    """A model from labelled texts; None unless both classes occur and some token tells them apart."""
    label = np.asarray(toxic)
    if not label.any() or label.all():
        return None
    names = choose_landmarks([t for t, y in zip(texts, label, strict=True) if y], [t for t, y in zip(texts, label, strict=True) if not y])
    if not names:
        return None
    landmarks = Landmarks(names)
    parts = [texts[i : i + PART] for i in range(0, len(texts), PART)]
    kernels: dict[str, np.ndarray] = {}
    for part in parts:
        kernels.update(landmarks.measure_all({t for x in part for t in tokens_of(x or "")} - kernels.keys()))
    rows, signs = [np.zeros(2 * len(names))], [-1.0]
    for text, y in zip(texts, label, strict=True):
        found = sentence_rows(text or "", kernels.keys() & set(tokens_of(text or "")), kernels)
        rows += found
        signs += [1.0 if y else -1.0] * len(found)
    # what the kernel tolerates shall count: landmarks in disguise are positive too
    disguised = [_both(k) for t in names for x in disguises(t) if (k := landmarks.measure(x)) is not None]
    rows += disguised
    signs += [1.0] * len(disguised)
    gram = np.array([[kernel(a, b) for b in names] for a in names])
    map_ = np.zeros((2 * len(names), 2 * len(names)))
    for k, g in enumerate((gram, gram**SHARP)):
        values, vectors = np.linalg.eigh(g)
        map_[k * len(names) : (k + 1) * len(names), k * len(names) : (k + 1) * len(names)] = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    signs_ = np.asarray(signs)
    # the sentence without resemblance stands for all clean ones like it
    weight = np.ones(len(signs_))
    weight[0] = max(1.0, (signs_ > 0).sum())
    weights, offset = _machine(np.asarray(rows) @ map_, signs_, weight)
    scorer = Scorer(landmarks, map_, weights, offset, 1.0, 0.0)
    scorer.hot = kernels
    scorer.slope, scorer.shift = _curve(np.concatenate([scorer.margins(part, fresh=False) for part in parts]), label.astype(float))
    scorer.seen, scorer.hot = set(), {}
    return scorer


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Scorer | None:
    """A model from the labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id"))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    by_hash = [F.xxhash64("__id"), F.col("__id")]
    some = known.filter("__y = 1").orderBy(*by_hash).limit(sample).unionByName(known.filter("__y <> 1").orderBy(*by_hash).limit(sample))
    # at most 2 * sample rows of bounded texts: small enough to send whatever the size of the corpus
    text = F.coalesce(F.col(text_col), F.lit(""))
    # of a longer text a stretch from a place by hash
    start = (1 + F.pmod(F.xxhash64(text), F.greatest(F.length(text) - longest + 1, F.lit(1)))).cast("int")
    texts = docs.select(F.col(id_col).alias("__id"), F.when(F.length(text) <= longest, text).otherwise(F.substring(text, start, F.lit(longest))).alias("__text"))
    rows = texts.join(F.broadcast(some), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).orderBy("__id").select("__text", "__y").collect()
    return fit([r["__text"] for r in rows], [int(r["__y"] == 1) for r in rows])


def score(docs: DataFrame, model: Scorer | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1."""
    if model is None:
        return docs.withColumn(out_col, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import copy

        scorer = copy.copy(sent.value)
        scorer.seen, scorer.hot = set(), {}
        for texts in batches:
            yield pd.Series(scorer.probability(scorer.margins(texts.tolist())))

    return docs.withColumn(out_col, scores(text_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that score under 0.5; their columns as they were."""
    model = train(docs, labels, text_col=text_col, **options)
    own = fresh(docs, "toxic")
    return score(docs, model, text_col, own).filter(F.col(own) < 0.5).select(*[f"`{c}`" for c in docs.columns])
