"""Operator 1, secret scans: fixed patterns plus character Markov models.

Two Markov models of characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A token is reported as ``markov``
when the log-likelihood ratio of the two says random. The spans of the fixed
patterns are always reported; model spans never overlap them.

Defined cases: a null or empty text has no spans; ids may be null or repeated
(each row is scanned by itself); extra input columns are not read and not
returned, so no name can clash; an empty table gives an empty result; texts are
scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_rows, sample_rows

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A maximal run shorter than the minimum can't hold a longer one: asking for the length here drops the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the models look at: all runs of these characters that are no number.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    CODE[ord(_c)] = _i
SIZE = len(ALPHABET) + 1


def codes(s: str) -> np.ndarray:
    """Alphabet positions, with one start symbol before and one end symbol after."""
    b = np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)
    return np.concatenate(([SIZE - 1], CODE[np.minimum(b, 127)], [SIZE - 1]))


@dataclass(frozen=True)
class MarkovModel:
    """log2 P(next | previous) of random strings minus that of ordinary identifiers."""

    ratio: np.ndarray

    @staticmethod
    def fit(samples: Iterable[tuple[str, bool]], smoothing: float = 0.5) -> MarkovModel:
        """samples: (string, is it random?). Additive smoothing; without samples the ratio is 0 everywhere."""
        counts = {True: np.zeros((SIZE, SIZE)), False: np.zeros((SIZE, SIZE))}
        for s, is_random in samples:
            c = codes(s)
            np.add.at(counts[bool(is_random)], (c[:-1], c[1:]), 1)
        logs = {}
        for k, n in counts.items():
            # back off to the class's own character frequencies, so that rare contexts stay sane
            base = (n.sum(0) + smoothing) / (n.sum() + smoothing * SIZE)
            logs[k] = np.log2((n + SIZE * smoothing * base) / (n.sum(1, keepdims=True) + SIZE * smoothing))
        return MarkovModel(logs[True] - logs[False])

    def score(self, s: str) -> float:
        """Bits of evidence that s is random."""
        c = codes(s)
        return float(self.ratio[c[:-1], c[1:]].sum())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the fixed patterns, code points, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterable[re.Match]:
    """Runs that touch no base span and hold a letter: digits alone are a number."""
    for m in RUN.finditer(text):
        if not m[0].isdigit() and any(c.isalpha() for c in m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base):
            yield m


def scan_text(text: str, model: MarkovModel | None, threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, of one text."""
    base = base_spans(text)
    if model is None:
        return base, base
    more = [(m.start(), 3, m.end()) for m in candidates(text, base) if model.score(m[0]) >= threshold]
    return base, sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, redacted string"


def scan_secrets(df: DataFrame, model: MarkovModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 24.0, redact: bool = False) -> DataFrame:
    """One row per input row: counts, spans, and with ``redact`` the text with each span replaced by ``[SECRET]``.

    ``redacted`` is null without ``redact`` and for null texts.
    """

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            base, spans = scan_text(text or "", model, threshold)
            kinds = [k for _, k, _ in spans]
            row = [i, *(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), mask(text, spans) if redact else None]
            for o, x in zip(out, row, strict=True):
                o.append(x)
        types = [pa.int64()] * 5 + [pa.string()] * 3
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "redacted"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, scan, SCHEMA)


def mask(text: str | None, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str | None:
    """text with every maximal union of spans replaced."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def random_samples(n: int, seed: int = 7) -> list[tuple[str, bool]]:
    """Labelled random strings over the alphabets that keys come in."""
    r = random.Random(seed)
    sets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return [("".join(r.choices(sets[i % len(sets)], k=r.randint(16, 48))), True) for i in range(n)]


ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")


def training_samples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, n_random: int = 4000) -> list[tuple[str, bool]]:
    """Labelled samples: synthetic random strings, and identifiers from a bounded sample of documents.

    ``sample_docs`` bounds the documents (those of the lowest hash). Their tokens
    outside base spans are ordinary, alone and joined as identifiers and paths
    are (camelCase, snake_case, kebab-case, with numbers); the values inside
    base spans are random. At most 200 tokens of each document come.
    """

    def tokens(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[str, bool]] = []
        for text in b.column(0).to_pylist():
            base = base_spans(text or "")
            out += [(text[a:e], True) for a, k, e in base if k]
            words = [m[0] for m in ORDINARY.finditer(text or "") if not any(a < m.end() and m.start() < e for a, _, e in base)]
            out += [(w, False) for w in words[:: -(-len(words) // 200) or 1]]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([r for _, r in out], pa.bool_())], ["s", "random"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chosen = sample_rows(chosen, sample_docs, "id", "secrets").select("text")
    got = sorted((x.s, x.random) for x in map_arrow(chosen, tokens, "s string, random boolean").collect())
    words = [s for s, is_random in got if not is_random and s.isalpha()]
    r = random.Random(11)
    joins = []
    for _ in range(min(4 * len(words), 8000)):
        a, b, n = r.choice(words), r.choice(words), r.randint(0, 2030)
        joins.append(r.choice([f"{a}{b.title()}{n}", f"{a.lower()}_{b.lower()}_{n}", f"{a.lower()}-{b.lower()}-{n}", f"/{a.lower()}/{b.lower()}/{n}", f"{a}{n}", f"{a.upper()}_{b.upper()}{n % 10}", f"{n}-{n % 12 + 1:02d}-{b.lower()}"]))
    return got + [(s, False) for s in joins] + random_samples(n_random)


def fit_model(df: DataFrame, **how) -> MarkovModel:
    """Train both Markov models on ``training_samples(df, **how)``."""
    return MarkovModel.fit(training_samples(df, **how))



def redact(df: DataFrame, model: MarkovModel | None, text_col: str = "text", threshold: float = 24.0) -> DataFrame:
    """df with every span in its text replaced by ``[SECRET]``; other columns stay."""

    def each(b: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        new = [mask(t, scan_text(t, model, threshold)[1]) if t else t for t in texts.to_pylist()]
        at = [n.lower() for n in b.schema.names].index(text_col.lower())
        cols = list(b.columns)
        cols[at] = pa.array(new, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays(cols, b.schema.names)

    return map_rows(df, each, text_col)
