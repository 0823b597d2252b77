import random
import zlib
from collections import Counter, defaultdict

from gridloom.llm import sharding as H

from .odd import no_docs, odd_docs, prose, rows


def check(out, want_rows, shards):
    assert len(out) == want_rows
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return slots


def test_odd_documents(spark):
    out = H.assign(odd_docs(spark), shards=3).collect()
    check(out, len(rows()), 3)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r.id, r.size, r.crc) for r in out) == want


def test_empty_table(spark):
    assert H.assign(no_docs(spark), shards=3).collect() == []


def corpus(n=3000):
    r = random.Random(3)
    shared = [prose(1000 + k, 30 + k % 50) for k in range(60)]
    out = [(k, shared[min(int(r.expovariate(0.15)), 59)] if r.random() < 0.4 else prose(k, r.randint(5, 120))) for k in range(n)]
    return out


def test_sizes_are_even_and_groups_gather(spark):
    docs = corpus()
    out = H.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shards=8).collect()
    check(out, len(docs), 8)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    mean = sum(load.values()) / 8
    assert max(load.values()) <= 1.03 * mean and min(load.values()) >= 0.97 * mean
    # neighbouring copies: pairs in the same shard, against 1 in 8 by chance
    groups = defaultdict(list)
    text = dict(docs)
    for r in out:
        groups[text[r.id]].append(r.shard)
    pairs = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    same = sum(n * (n - 1) // 2 for g in groups.values() for n in Counter(g).values())
    assert same / pairs > 0.5


def test_one_group_of_a_third_of_all_rows(spark):
    docs = [(k, "the same text in many rows" if k % 3 == 0 else prose(k, 12)) for k in range(1800)]
    out = H.assign(spark.createDataFrame(docs, "doc_id long, text string"), shards=6).collect()
    check(out, 1800, 6)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.05 * sum(load.values()) / 6


def test_few_links_are_cut_where_most_documents_are_copies(spark):
    """Groups of 2 to 4 equal texts make four fifths of the bytes; rounds go on until nothing more gathers."""
    r = random.Random(9)
    docs, k = [], 0
    while k < 4000:
        t, n = prose(5000 + k, r.randint(20, 60)), r.choice([1, 2, 3, 4])
        docs += [(k + c, t) for c in range(n)]
        k += n
    out = H.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shards=10).collect()
    check(out, len(docs), 10)
    load, groups, text = Counter(), defaultdict(list), dict(docs)
    for x in out:
        load[x.shard] += x.size
        groups[text[x.id]].append(x.shard)
    mean = sum(load.values()) / 10
    assert max(load.values()) <= 1.03 * mean and min(load.values()) >= 0.97 * mean
    linked = [g for g in groups.values() if len(g) > 1]
    assert sum(len(set(g)) > 1 for g in linked) <= 0.08 * len(linked)
