"""Operator 2, quality classifier: a weak-label model and a hashed linear scorer.

1. Heuristic labellers vote good (1), bad (-1) or abstain (0) on every document.
2. Expectation-maximisation estimates the labellers' accuracies and the share of
   good documents from the counts of all vote patterns, over all documents.
3. The posteriors label a bounded sample of documents (``sample_docs``), on which a
   logistic scorer over hashed features is fitted.
4. The scorer judges every document.

Defined cases: null and empty texts get no features but the bias and the length
feature, and are judged by them; ties in score at the threshold keep; repeated
rows are judged alike; extra columns are not read; an empty table, or one where no
labeller votes, gives an empty result or keeps all. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_rows, sample_rows

DIM = 1 << 14
#: A labeller votes bad on this share of good documents at most. Faults hardly ever come together, so votes
#: are dependent given bad; without the bound, good documents could take in one of the faults whole.
FALSE_ALARM = 0.002
#: Bytes by shape: letters a or A, digits 0, bytes of other scripts a, white space one space, marks as they are.
SHAPE = bytes(range(256)).translate(bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else 32 if c in (9, 10, 11, 12, 13, 32) else c
    for c in range(256)))

STATS = ("n_words", "symbols", "marks", "upper", "pipes", "repeats", "distinct", "dup_lines", "mean_word")


def statistics(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' measures, and the text's bytes by shape."""
    raw = (text or "").encode("utf-8", "replace")
    shape = np.frombuffer(raw.translate(SHAPE), dtype=np.uint8)
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(STATS)), shape
    count = np.bincount(shape, minlength=256)
    chars = max(1, len(raw) - int(count[32]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.array([
        n, sum(int(count[ord(c)]) for c in "#*$%&<>|~^=_{}[]\\@") / chars, int(count[33] + count[63]) / n, int(count[65]) / chars, int(count[124]) / n,
        same / n, len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), chars / n,
    ]), shape


def votes(s: np.ndarray) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 abstain. They overlap, and none sees all faults."""
    n, symbols, marks, upper, pipes, repeats, distinct, dup_lines, mean_word = s.tolist()
    if n == 0:
        return [0, 0, 0, 0, 0, 0, -1]
    return [
        -1 if symbols > 0.05 else 1 if symbols < 0.01 else 0,
        -1 if marks > 0.4 else 1 if marks < 0.1 else 0,
        -1 if upper > 0.4 else 1 if upper < 0.12 else 0,
        -1 if pipes > 0.15 else 1 if pipes == 0 else 0,
        -1 if repeats > 0.25 else 1 if repeats < 0.08 else 0,
        -1 if n >= 30 and distinct < 0.2 or dup_lines > 0.5 else 1,
        -1 if n < 4 or mean_word > 20 else 1 if 3 <= mean_word <= 12 and n >= 10 else 0,
    ]


N_VOTERS = 7


def features(s: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (slots, values): shares of shape trigrams, and the measures' bins."""
    bins = np.array([np.log1p(s[0]) * 2, s[1] * 40, s[2] * 10, s[3] * 20, s[4] * 10, s[5] * 20, s[6] * 10, s[7] * 10, s[8]]).astype(np.int64).clip(0, 30)
    slots = [(np.arange(len(STATS)) * 31 + bins) * 7919 % DIM, np.array([DIM])]
    values = [np.ones(len(STATS)), np.ones(1)]
    if len(shape) >= 3:
        c = shape.astype(np.int64)
        h = np.bincount(((c[:-2] * 65536 + c[1:-1] * 256 + c[2:]) * 2654435761 >> 7) % DIM, minlength=DIM)
        at = np.flatnonzero(h)
        slots.append(at)
        values.append(np.sqrt(h[at] / (len(shape) - 2)))
    return np.concatenate(slots), np.concatenate(values)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and per labeller P(vote | class) for the votes -1, 0, 1."""

    prior: float
    table: np.ndarray  # voter, class, vote + 1

    @staticmethod
    def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """Expectation-maximisation over vote patterns, started from the votes' majority."""
        p = patterns.astype(np.int64)
        q = 1 / (1 + np.exp(-np.where((p < 0).any(1), -1.0, 1.0) * 2.0)) if len(p) else np.zeros(0)
        model = LabelModel(0.5, np.full((N_VOTERS, 2, 3), 1 / 3))
        for _ in range(rounds):
            table = np.full((N_VOTERS, 2, 3), 0.5)
            for v in range(N_VOTERS):
                for k, w in ((1, q), (0, 1 - q)):
                    np.add.at(table[v, k], p[:, v] + 1, w * counts)
            table /= table.sum(2, keepdims=True)
            # the constrained maximum: what stands above the bound goes to the other votes
            low = np.minimum(table[:, 1, 0], FALSE_ALARM)
            table[:, 1, 1:] *= ((1 - low) / (1 - table[:, 1, 0]))[:, None]
            table[:, 1, 0] = low
            prior = float(np.clip((q * counts).sum() / max(1, counts.sum()), 0.01, 0.99)) if len(p) else 0.5
            model = LabelModel(prior, table)
            new = model.posterior(p)
            if len(p) == 0 or np.abs(new - q).max() < 1e-9:
                break
            q = new
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        if not len(patterns):
            return np.zeros(0)
        logs = [np.log(self.table[np.arange(N_VOTERS), k, patterns + 1]).sum(1) + np.log(x) for k, x in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, rounds: int = 30, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
        """Logistic regression on soft labels by AdaGrad; both classes weigh alike."""
        w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
        good = max(1e-9, targets.sum())
        bad = max(1e-9, len(targets) - targets.sum())
        order = np.random.default_rng(3)
        for _ in range(rounds):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                y = targets[i]
                pred = 1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))
                step = ((1 - y) * pred / bad - y * (1 - pred) / good) * len(rows) / 2 * x + decay * w[at]
                g2[at] += step * step
                w[at] -= rate * step / np.sqrt(g2[at])
        return Scorer(w.astype(np.float32))

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(np.clip(self.weights[at] @ x, -30, 30))


def source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def vote_patterns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pattern, n): how many documents have each vote pattern, a number in base 3; at most 3^7 rows."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        code = [sum((v + 1) * 3**k for k, v in enumerate(votes(statistics(t)[0]))) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64())], ["pattern"])

    return map_arrow(source(df, id_col, text_col), each, "pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def decode(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 - 1 for k in range(N_VOTERS)]


@dataclass(frozen=True)
class QualityModel:
    """The scorer is fitted with both classes weighing alike; the share of good documents comes back in here."""

    labels: LabelModel
    scorer: Scorer

    def score(self, s: np.ndarray, shape: np.ndarray) -> float:
        """P(good): the scorer's odds times the prior odds."""
        return 1 / (1 + np.exp(-self.scorer.logit(*features(s, shape)) - np.log(self.labels.prior / (1 - self.labels.prior))))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000) -> QualityModel:
    """Fit both models. ``sample_docs`` bounds the rows the scorer learns from: those of the lowest id hash."""
    got = sorted((r.pattern, r.n) for r in vote_patterns(df, id_col, text_col).collect())
    labels = LabelModel.fit(np.array([decode(p) for p, _ in got]).reshape(-1, N_VOTERS), np.array([n for _, n in got], dtype=float))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in b.column(1).to_pylist()]
        parts = [features(*r) for r in rows]
        cols = [[votes(s) for s, _ in rows], [a.tolist() for a, _ in parts], [x.tolist() for _, x in parts]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32())), strict=True)], ["v", "at", "x"])

    chosen = sample_rows(source(df, id_col, text_col), sample_docs, "id", "quality")
    # in one order, whatever the partitions: fitting goes row by row
    rows = sorted(map_arrow(chosen, each, "v array<int>, at array<int>, x array<float>").collect(), key=lambda r: (r.v, r.at, r.x))
    if not rows:
        return QualityModel(labels, Scorer(np.zeros(DIM + 1, dtype=np.float32)))
    targets = labels.posterior(np.array([r.v for r in rows]))
    return QualityModel(labels, Scorer.fit([(np.array(r.at), np.array(r.x)) for r in rows], targets))


SCHEMA = "id long, score double, weak_label double, kept boolean"


def classify(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, weak_label, kept) per row: the scorer's probability of good under the prior, the label model's, and score >= threshold."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in b.column(1).to_pylist()]
        score = np.array([model.score(*r) for r in rows])
        weak = model.labels.posterior(np.array([votes(s) for s, _ in rows]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(weak), pa.array(score >= threshold)], ["id", "score", "weak_label", "kept"])

    return map_arrow(source(df, id_col, text_col), each, SCHEMA)


def keep_good(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that ``classify`` keeps, with all their columns."""

    def each(b: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        return b.filter(pa.array([model.score(*statistics(t)) >= threshold for t in texts.to_pylist()], pa.bool_()))

    return map_rows(df, each, text_col)
