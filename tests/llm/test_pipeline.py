import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from gridloom.llm import mixing, quality, secrets, simhash

from .odd import no_docs, odd_docs, prose
from .test_simhash import brute, by_definition

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    out = []
    for k in range(60):
        t = prose(k, 40 + k)
        out.append((k, t, "en", f"s{k % 3}", len(t)))
    for k in range(60, 75):
        t = "word### other*** this$$$ that&&& more%%% " * 12
        out.append((k, t + str(k), "en", "s1", len(t) + 2))
    out += [(100 + k, *out[k][1:]) for k in range(10)]
    key = prose(500, 60) + " token = 0123456789abcdef0123456789abcdef0123 " + prose(501, 30)
    return out + [(200, key, "en", "s0", len(key)), (201, None, None, None, None), (202, "", "en", None, 0)]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), COLUMNS).repartition(3)
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    stages = dict(C.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "packing"]

    good = stages["quality"](spark, docs, d)
    kept = {r.id for r in quality.classify(docs, quality.fit(docs)).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    assert set(range(60)) <= kept and not kept & set(range(60, 75))

    good.write.parquet(f"{d}/good")
    good = spark.read.parquet(f"{d}/good")
    one = stages["near_duplicates"](spark, good, d)
    want = {c for _, _, c in brute([(r.doc_id, by_definition(r.text)) for r in good.collect()])}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns

    one.write.parquet(f"{d}/one")
    one = spark.read.parquet(f"{d}/one")
    clean = stages["secrets"](spark, one, d)
    by = {r.doc_id: r for r in clean.collect()}
    assert by.keys() == want and "0123456789abcdef0123" not in by[200].text and by[200].n_chars == len(by[200].text)
    assert all(by[r.doc_id].text == r.text for r in one.collect() if r.text and not secrets.base_spans(r.text))

    clean.write.parquet(f"{d}/clean")
    clean = spark.read.parquet(f"{d}/clean")
    mixed = stages["mixing"](spark, clean, d)
    copies = {r.id: r.copies for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(copies) and mixed.columns == docs.columns

    packed = stages["packing"](spark, mixed, d).collect()
    tokens = defaultdict(int)
    for r in packed:
        tokens[r.doc_id] += r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    per = {r.doc_id: r.doc_tokens for r in packed}
    assert all(tokens[i] == per[i] * copies[i] for i in tokens) and set(tokens) == {i for i, c in copies.items() if c}

    whole = Counter((r.doc_id, r.length) for r in C.run(spark, d).collect())
    assert sum(n * k for (_, n), k in whole.items()) > 0 and {i for i, _ in whole} <= want


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, name):
    stage = dict(C.STAGES)[name]
    for docs in (odd_docs(spark), no_docs(spark)):
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and len(rows) <= 2 * docs.count()
    assert simhash.fingerprint(None) == 0


def test_no_sql_for_it():
    assert C.ORACLE_SQL is None
