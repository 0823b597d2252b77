import random

import pytest

import corpus_pipeline as C
from gridloom.llm import jaccard as J
from gridloom.llm.components import connected_components
from gridloom.llm.simhash import fingerprint, signed

from .odd import no_docs, odd_docs, prose, rows


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def kept(docs):
    """The smallest id of every component of all pairs of similarity 4 / 5 or more."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min((i is None, i or 0), least.get(r, (True, 0)))
    return sorted(str(None if none else i) for none, i in least.values())


def planted():
    """Texts with copies that differ in 0 to 12 words, the copies of one of them many."""
    r = random.Random(5)
    out = []
    for k in range(14):
        words = prose(100 + k, 60 + 30 * k).split()
        for c in range(120 if k == 4 else 8):
            w = list(words)
            for _ in range(c % 13):
                w[r.randrange(len(w))] = f"changed{r.randrange(50)}"
            out.append(" ".join(w))
    out += ["a passage that stands in all of these texts and fills most of each " * 2 + prose(700 + k, 12) for k in range(90)]
    return list(enumerate(out + [prose(900 + k, 50) for k in range(60)]))


@pytest.mark.parametrize("hot", [40, 2, 100_000])
def test_planted_near_copies(spark, hot):
    docs = planted()
    want = kept(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert len(docs) > len(want) > 150
    assert sorted(str(r.doc_id) for r in J.deduplicate(df, hot=hot).collect()) == want


def test_the_stage_drops_near_copies(spark, tmp_path):
    """Similarity 0.8 or more at more than 4 bits of the fingerprints of op4."""
    docs = planted()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(C.STAGES)["near_duplicates"](spark, df, str(tmp_path))
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == kept(docs)


def test_odd_and_no_documents(spark):
    got = J.deduplicate(odd_docs(spark))
    assert got.columns == odd_docs(spark).columns
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == kept([(i, t) for i, t, *_ in rows()])
    assert J.deduplicate(no_docs(spark)).count() == 0


def test_the_stage_links_fingerprints_first(spark, tmp_path, monkeypatch):
    """What the SimHash operator links is checked first and made one group; then only pairs of different groups are compared."""
    docs = planted()
    calls = []

    def spy(pairs, *how):
        links = similar(pairs, *how)
        calls.append(({(r.u, r.v) for r in pairs.collect()}, {(r.u, r.v) for r in links.collect()}))
        return links

    similar = J.similar
    monkeypatch.setattr(J, "similar", spy)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in dict(C.STAGES)["near_duplicates"](spark, df, str(tmp_path)).collect()) == kept(docs)
    fps, sets = {}, {}
    for _, t in docs:
        node = J.digest(J.shingles(t))
        fps[node], sets[node] = min(fps.get(node, 1 << 63), signed(fingerprint(t, 5))), shingle_set(t)

    def bits(u, v):
        return ((fps[u] ^ fps[v]) & (1 << 64) - 1).bit_count()

    (pairs, links), *later = calls
    assert links and all(bits(u, v) <= 4 for u, v in pairs)
    assert links == {(u, v) for u, v in pairs if 5 * len(sets[u] & sets[v]) >= 4 * len(sets[u] | sets[v])}
    group = {r.node: r.root for r in connected_components(spark.createDataFrame(list(links), "u long, v long")).collect()}
    assert all(group.get(u, u) != group.get(v, v) for more, _ in later for u, v in more)
    assert any(bits(u, v) > 4 for _, found in later for u, v in found)


def test_batches_are_bounded(spark, tmp_path, monkeypatch):
    """No pass over the texts sends more than a piece to Python at once, by rows or by bytes."""
    log, slice_up = str(tmp_path / "batches"), J.pieces

    def spy(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write(f"{b.num_rows} {sum(len(t) for c in b.columns for t in c.to_pylist() if isinstance(t, str))}\n")
            yield from slice_up([b])

    monkeypatch.setattr(J, "pieces", spy)
    names = [f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Records", "Bytes")]
    before = [spark.conf.get(k, None) for k in names]
    # every text twice, so that all three passes have rows
    short = [prose(k % 700, 30) + f" {k % 700}" for k in range(1400)]
    long = [f"{k % 6} " + "word " * (4 << 18) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(short + long)), "doc_id long, text string").coalesce(1)
    assert J.deduplicate(docs).count() == 706
    assert [spark.conf.get(k, None) for k in names] == before
    got = [tuple(map(int, line.split())) for line in open(log)]
    assert sum(n for n, _ in got) >= 2 * 1412
    assert max(n for n, _ in got) <= J.PIECE
    assert max(size for _, size in got) <= J.PIECE_BYTES + (6 << 20)
