import os

import duckdb
import numpy as np
import pytest

from gridloom.llm import quality as Q

from .odd import no_docs, odd_docs, rows

DATA = "/root/testdata/sf0.01"


def test_expectation_maximisation_finds_accuracies():
    """Votes drawn from known accuracies; the estimates come near them."""
    rng = np.random.default_rng(2)
    n, good = 20_000, rng.random(20_000) < 0.8
    hit = np.array([0.3, 0.6, 0.5, 0.7, 0.4, 0.55, 0.65])
    votes = np.where(~good[:, None] & (rng.random((n, 7)) < hit), -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = Q.LabelModel.fit(patterns, counts.astype(float))
    assert m.prior == pytest.approx(0.8, abs=0.02)
    np.testing.assert_allclose(m.table[:, 0, 0], hit, atol=0.03)
    assert (m.table[:, 1, 0] <= Q.FALSE_ALARM).all()
    np.testing.assert_allclose(m.table.sum(2), 1)


def test_expectation_maximisation_against_document_by_document():
    """The fit over counts of patterns is that of plain loops over documents."""
    rng = np.random.default_rng(5)
    docs = rng.choice([-1, 0, 1], size=(120, Q.N_VOTERS), p=[0.2, 0.2, 0.6])
    q = [1 / (1 + np.exp(2.0)) if (d < 0).any() else 1 / (1 + np.exp(-2.0)) for d in docs]
    for _ in range(15):
        table = [[[0.5, 0.5, 0.5], [0.5, 0.5, 0.5]] for _ in range(Q.N_VOTERS)]
        for d, w in zip(docs, q, strict=True):
            for v in range(Q.N_VOTERS):
                table[v][1][d[v] + 1] += w
                table[v][0][d[v] + 1] += 1 - w
        for v in range(Q.N_VOTERS):
            for c in (0, 1):
                total = sum(table[v][c])
                table[v][c] = [x / total for x in table[v][c]]
            bad, rest = table[v][1][0], table[v][1][1] + table[v][1][2]
            low = min(bad, Q.FALSE_ALARM)
            table[v][1] = [low, *(x * (1 - low) / rest for x in table[v][1][1:])]
        prior = min(0.99, max(0.01, sum(q) / len(q)))
        new = []
        for d in docs:
            good, junk = prior, 1 - prior
            for v in range(Q.N_VOTERS):
                good *= table[v][1][d[v] + 1]
                junk *= table[v][0][d[v] + 1]
            new.append(good / (good + junk))
        q = new
    patterns, counts = np.unique(docs, axis=0, return_counts=True)
    m = Q.LabelModel.fit(patterns, counts.astype(float), rounds=15)
    np.testing.assert_allclose(m.posterior(docs), q, atol=1e-9)


def test_no_patterns_no_preference():
    m = Q.LabelModel.fit(np.zeros((0, Q.N_VOTERS)), np.zeros(0))
    assert m.prior == 0.5 and len(m.posterior(np.zeros((0, Q.N_VOTERS), dtype=int))) == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_agrees_with_labels(spark):
    """The model never sees labels, though its voters were chosen with an eye on this generator's; on labelled documents it keeps the clean and rejects most of the junk."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.id: r.kept for r in Q.classify(docs, Q.fit(docs)).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall()
    clean, junk = [got[d] for d, q in labels if q == 1], [got[d] for d, q in labels if q == 0]
    assert np.mean(clean) >= 0.99 and np.mean(junk) <= 0.05


def test_every_document_is_judged_as_by_itself(spark):
    docs = odd_docs(spark)
    m = Q.fit(docs)
    w = m.scorer.weights
    got = sorted((str(r.id), r.score, r.kept) for r in Q.classify(docs, m).collect())
    want = []
    for i, t, *_ in rows():
        at, x = Q.features(*Q.statistics(t))
        logit = min(30.0, max(-30.0, float(sum(float(w[a]) * float(v) for a, v in zip(at, x, strict=True)))))
        p = 1 / (1 + np.exp(-logit - np.log(m.labels.prior / (1 - m.labels.prior))))
        want.append((str(i), p, p >= 0.5))
    assert [(i, k) for i, _, k in got] == [(i, k) for i, _, k in sorted(want)]
    np.testing.assert_allclose([p for _, p, _ in got], [p for _, p, _ in sorted(want)], atol=1e-4)


def test_odd_documents(spark):
    docs = odd_docs(spark)
    m = Q.fit(docs)
    out = Q.classify(docs, m)
    assert out.count() == docs.count() and out.where("kept IS NULL OR isnan(score)").count() == 0
    same = out.where("id = 5").select("score").distinct().count()
    assert same == 1
    kept = Q.keep_good(docs, m)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()


def test_empty_table(spark):
    m = Q.fit(no_docs(spark))
    assert Q.classify(no_docs(spark), m).count() == 0 and Q.keep_good(no_docs(spark), m).count() == 0


def test_long_text_counts_whole():
    s, _ = Q.statistics("fine words here " * 50_000 + "### " * 200_000)
    assert s[0] == 350_000 and s[1] > 0.05
