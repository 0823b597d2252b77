import random

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gridloom.llm import simhash as S
from gridloom.llm.components import connected_components

from .odd import no_docs, odd_docs, prose, rows


def by_definition(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """Component of each node by all pairs within 4 bits: the smallest id reachable."""
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = {}
    for k in range(n):
        if fps[k][0] is not None:
            r = find(k)
            ids[r] = min(ids.get(r, fps[k][0]), fps[k][0])
    return sorted((str(fps[k][0]), fps[k][1], ids.get(find(k))) for k in range(n))


def test_fingerprints():
    for _, t, *_ in rows():
        assert S.fingerprint(t) == by_definition(t)


def result(df, **how):
    return sorted((str(r.id), r.fp & (1 << 64) - 1, r.component) for r in S.near_duplicates(df, **how).collect())


def test_odd_documents(spark):
    fps = [(i, by_definition(t)) for i, t, *_ in rows()]
    assert result(odd_docs(spark)) == brute(fps)


def near_texts():
    r = random.Random(6)
    out = []
    for k in range(12):
        words = prose(100 + k, 400).split()
        for c in range(8):
            w = list(words)
            for _ in range(c):
                w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out + [prose(900 + k, 50) for k in range(60)]


def test_components_with_and_without_hot_keys(spark):
    ts = near_texts()
    want = brute([(k, by_definition(t)) for k, t in enumerate(ts)])
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(4)
    for hot in (64, 2):
        assert result(docs, hot=hot) == want


def test_links_of_random_fingerprints(spark):
    """Chains of fingerprints 0 to 5 bits apart, through the pigeonring and through shared points."""
    r = random.Random(1)
    fps = []
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(6):
            fps.append(x)
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
    # keys of two segments that many share, of which few are near one another, and many near one point
    for start, n in ((0, 26), (26, 26), (52, 25)):
        own = r.getrandbits(26)
        for _ in range(25):
            x = 0
            for k in range(64):
                x |= (own >> k & 1 if k < n else r.getrandbits(1)) << (start + k) % 64
            fps += [x, x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)]
    middle = r.getrandbits(64)
    for _ in range(40):
        x = middle
        for b in r.sample(range(64), r.randint(0, 3)):
            x ^= 1 << b
        fps.append(x)
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp long")
    for hot in (64, 20, 8, 1):
        got = {r_.fp & (1 << 64) - 1: r_.root for r_ in S.component_roots(df, hot).collect()}
        want = brute(list(enumerate(fps)))
        classes, mine = {}, {}
        for (_, f, c), g in ((w, got.get(w[1], w[1])) for w in want):
            classes.setdefault(c, set()).add(f)
            mine.setdefault(g, set()).add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_deduplicate_keeps_one_of_each_component(spark):
    docs = odd_docs(spark)
    out = S.deduplicate(docs)
    assert out.columns == docs.columns
    comp = {}
    for i, f, c in brute([(i, by_definition(t)) for i, t, *_ in rows()]):
        comp.setdefault(c if c is not None else (i, f), []).append(i)
    got = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(got) == len(comp)
    assert sorted(str(g) for g in got) == sorted(str(c) if not isinstance(c, tuple) else c[0] for c in comp)


def test_empty_table(spark):
    assert S.near_duplicates(no_docs(spark)).count() == 0 and S.deduplicate(no_docs(spark)).count() == 0


def test_connected_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (160, 159)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 500 for k in range(500, 560)) and 7 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).agg(F.count("*")).first()[0] == 0
