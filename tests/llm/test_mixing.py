import math
import random
import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import mixing as M

from .odd import no_docs, odd_docs, rows


def n_words(t):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight; what stands above a cap is shared again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(df, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += n_words(t)
    want = targets(sizes)
    got = M.mix(df).collect()
    assert len(got) == len(docs)
    assert Counter((r.id, r.size, r.source_size) for r in got) == Counter((i, n_words(t), sizes[s]) for i, t, s in docs)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 2
    return got, want


def test_odd_documents(spark):
    check(odd_docs(spark), [(i, t, s) for i, t, _, s, *_ in rows()])


def test_targets_are_met(spark):
    r = random.Random(3)
    docs = [(k, "w " * r.randint(1, 60), r.choice(["a", "b", "b", "b", "ä", "z", None])) for k in range(6000)]
    got, want = check(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4), docs)
    taken = defaultdict(int)
    for x in got:
        taken[x.source] += x.size * x.copies
    assert all(abs(taken[s] - t) <= 0.06 * t for s, t in want.items())


def test_rows_without_ids_of_their_own_meet_the_targets(spark, monkeypatch):
    """Null ids, one id in many rows, and rows that are equal in everything: each row has its own draw."""
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 300)
    r = random.Random(4)
    docs = [(None, "w " * r.randint(1, 60), "ab"[k % 2]) for k in range(3000)] + [(7, "w " * r.randint(1, 60), "c") for k in range(2000)]
    docs += [(8, "equal rows", "d")] * 2000 + [(None, None, "e")] * 10 + [(100 + k, "w " * r.randint(1, 60), "f") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += n_words(t)
    want, taken = targets(sizes), defaultdict(int)
    got = M.mix(df).collect()
    assert Counter((x.id, x.size, x.source) for x in got) == Counter((i, n_words(t), s) for i, t, s in docs)
    for x in got:
        taken[x.source] += x.size * x.copies
    assert all(abs(taken[s] - t) <= 0.06 * t for s, t in want.items()), (want, taken)
    again = M.mix(df.repartition(7))
    assert Counter(tuple(x) for x in got) == Counter(tuple(x) for x in again.collect())
    assert Counter(x.doc_id for x in M.emit(df).select("doc_id").collect()) == +sum((Counter({x.id: x.copies}) for x in got), Counter())


def test_reruns_and_partitionings_agree(spark):
    a, b = M.mix(odd_docs(spark)), M.mix(odd_docs(spark).repartition(1))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_emitted_rows(spark):
    docs = odd_docs(spark)
    out = M.emit(docs)
    want = Counter()
    for r in M.mix(docs).collect():
        want[r.id] += r.copies
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == +want


def test_empty_table(spark):
    assert M.mix(no_docs(spark)).count() == 0 and M.emit(no_docs(spark)).count() == 0


def test_many_sources_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_ROWS", 1)
    check(odd_docs(spark), [(i, t, s) for i, t, _, s, *_ in rows()])
