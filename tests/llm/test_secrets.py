import hashlib
import random
import re

import pytest

from gridloom.llm import secrets as S

from .odd import no_docs, odd_docs, rows


def by_contract(text):
    """Spans of the base patterns, each found on its own by the plain pattern."""
    text = text or ""
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[0], order.index(s[1])))


MODEL = S.MarkovModel.fit([(w, False) for w in "getUserName2 parse_json_v3 build-2024-10 /usr/local/lib64 ClassLoader11 thread_pool_8 index_2_of_3".split() * 20] + S.random_samples(2000))


def test_base_spans_by_fuzz():
    r = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", " = ", ": '", '"', "=", "abcdef", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "deadbeef", " ", "\n", "ſecret", "K", "x", ".-_", "é", "😀"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert [(a, S.KINDS[k], e) for a, k, e in S.base_spans(t)] == by_contract(t)


def test_scan_of_odd_documents(spark):
    got = S.scan_secrets(odd_docs(spark), MODEL, redact=True).collect()
    assert len(got) == len(rows())
    want = {}
    for i, t, *_ in rows():
        base = by_contract(t)
        want.setdefault(i, []).append((hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, k, e in base).encode()).hexdigest(), sum(k == "assign" for _, k, _ in base), t))
    for r in got:
        assert (r.base_sha256, r.n_assign) in {(h, n) for h, n, _ in want[r.id]}
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert (kinds.count("access"), kinds.count("hex"), kinds.count("markov")) == (r.n_access, r.n_hex, r.n_markov)
    key = next(r for r in got if r.id == 13)
    assert key.n_assign == 1 and key.n_access == 1 and key.n_hex == 1 and key.redacted == '[SECRET]" and [SECRET] here'


def test_model_tells_random_from_ordinary():
    held = S.random_samples(400, seed=99)
    assert sum(MODEL.score(s) >= 24 for s, _ in held if len(s) >= 24) >= 0.9 * sum(len(s) >= 24 for s, _ in held)
    names = ["getUserName2024x", "parse_json_v3_final", "/usr/local/lib64/python3", "thread_pool_8_index_2", "build-2024-10-release"]
    assert not any(MODEL.score(n) >= 24 for n in names)


def test_model_spans_add_to_base_ones():
    key = "Zk9qXw3RtB7mLp2VhNc8YdFs5GjQa"
    base, spans = S.scan_text(f"see {key} and token=abcdefgh", MODEL, 24.0)
    assert S.joined(base) == "assign:38:52" and S.joined(spans) == "markov:4:33,assign:38:52"


def test_untrained_and_empty(spark):
    assert S.fit_model(no_docs(spark)).score("anything0123456789") is not None
    assert S.scan_secrets(no_docs(spark), None).count() == 0
    assert S.MarkovModel.fit([]).score("abc") == 0.0
    assert S.redact(no_docs(spark), None).columns == no_docs(spark).columns


def test_redaction_keeps_rows_and_columns(spark):
    docs = odd_docs(spark)
    out = S.redact(docs, MODEL)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    assert by[0] is None and by[1] == "" and "[SECRET]" in by[13] and "AKIA" not in by[13]


@pytest.mark.parametrize("text", [None, ""])
def test_mask_of_nothing(text):
    assert S.mask(text, []) == text
