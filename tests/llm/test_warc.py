import base64
import hashlib
import random

from pyspark.sql import functions as F

from gridloom.llm import queries, warc as W
from gridloom.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, payload string, digest string, id int"


def pages(spark):
    same = "<p>same</p>"
    rows = [
        (1, "http://a.example/x?q=1", same), (2, "http://a.example/y", same), (5, None, same), (3, "", None), (4, "relative", ""), (6, "http://b.example", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
        (7, "http://b.example/é ü", "naïve 日本 😀"), (8, "https://c.example/#f", "x" * 300_000), (9, "u", "tie"), (9, "v", "tie"), (9, "v", "tie"), (None, "n", same), (None, None, None), (10, "w", "tie"),
    ]
    return spark.createDataFrame([(*r, "p", "d", 1) for r in rows], SCHEMA).repartition(3), rows


def assembled(spark, df, **how):
    at = shared_path(spark, "warc")
    W.write_archives(df, at, **how)
    return W.assemble(W.verified(W.read_records(spark, at))), at


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark):
    df, rows = pages(spark)
    got, at = assembled(spark, df)
    out = got.collect()
    assert len(out) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[sha(h)] = max(last.get(sha(h), i), i)
    for r in out:
        i = r.metadata.page_id
        d = r.response.d.split(":")[1]
        assert r.request is not None and r.request.http.startswith("GET ")
        if i is not None and i < last[d]:
            assert r.response.kind == "revisit" and r.response.refers_page == last[d] and r.response.payload_bytes is None
        else:
            assert r.response.kind == "response" and r.response.intact
    by = {(r.metadata.page_id, r.response.d.split(":")[1], r.metadata.payload_length) for r in out}
    assert by == {(i, sha(h), len((h or "").encode())) for i, _, h in rows}
    payloads = W.read_records(spark, at).where("kind = 'response'").select("payload").collect()
    assert {bytes(p.payload).decode() for p in payloads} == {h or "" for _, _, h in rows}


def test_small_payloads_can_be_exempt(spark):
    df, _ = pages(spark)
    got, _ = assembled(spark, df, least=5)
    kinds = {(r.metadata.page_id, r.response.kind) for r in got.collect()}
    assert (3, "response") in kinds and (4, "response") in kinds and (1, "revisit") in kinds and (9, "response") in kinds


def test_empty_table(spark):
    df, _ = pages(spark)
    got, _ = assembled(spark, df.limit(0))
    assert got.count() == 0


def test_query(spark, tmp_path):
    df, rows = pages(spark)
    df.where("page_id IS NOT NULL AND page_id <> 9").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.op5_warc(spark, str(tmp_path)).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 5 and got[5].refers_to is None and got[1].payload_bytes == 11
    assert got[3].record_type == "revisit" and got[3].refers_to == 4 and got[3].payload_bytes == 0
    assert all(r.intact for r in got.values()) and got[8].payload_digest == sha("x" * 300_000)


def test_record_boundaries_are_checked():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nab: "
    end = b"\r\n\r\n"
    for chunks in ([(good + end) * 2], [good + end, good + end], [good, end, good, end, end], [bytes([c]) for c in (good + end) * 2]):
        assert [(h["content-length"], b) for h, b in W.parse(chunks)] == [("4", b"ab: ")] * 2
    assert list(W.parse([])) == []
    for bad in (good + b"x" + end, b"junk" + end, good, good[:20], good[:-1] + end):
        try:
            list(W.parse([bad]))
        except (ValueError, KeyError):
            continue
        raise AssertionError(bad)


def test_any_payload_comes_back(spark):
    """Line breaks in any mixture, and pages that are longer than any buffer of the reader."""
    r = random.Random(6)
    bits = ["\r", "\n", "\r\n", "\r\n\r\n", "\n\n", "a", "é", "WARC/1.1\r\nContent-Length: 2\r\n\r\n", " "]
    docs = [(k, "http://h.example/" + str(k), "".join(r.choices(bits, k=r.randint(0, 12)))) for k in range(400)]
    docs += [(1000 + k, "u", "".join(r.choices(bits, k=300_000)) + str(k)) for k in range(12)]
    df = spark.createDataFrame(docs, "page_id long, url string, html string").repartition(3)
    got, at = assembled(spark, df)
    out = got.collect()
    assert len(out) == len(docs) and all(x.response.intact for x in out if x.response.kind == "response")
    payloads = W.read_records(spark, at).where("kind = 'response'").select("payload").collect()
    assert {bytes(p.payload).decode() for p in payloads} == {h for _, _, h in docs}


def test_record_names_do_not_depend_on_partitions(spark):
    df, _ = pages(spark)
    names = []
    for d in (df, df.repartition(1), df.repartition(5)):
        at = shared_path(spark, "warc")
        W.write_archives(d, at)
        names.append(sorted(x.record_id for x in W.read_records(spark, at).select("record_id").collect()))
    assert names[0] == names[1] == names[2] and len(set(names[0])) == len(names[0]) == 42


def test_names_are_the_same_in_every_run(spark):
    a = spark.range(1).select(W.urn(F.lit("response"), F.lit(5), F.lit("x"))).first()[0]
    assert a == spark.range(1).select(W.urn(F.lit("response"), F.lit(5), F.lit("x"))).first()[0] and a.startswith("<urn:uuid:")
