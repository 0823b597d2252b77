import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import packing as P

from .odd import no_docs, odd_docs, prose, rows

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(reference, text):
    return [*reference.encode(text or "", add_special_tokens=False).ids, 2]


def test_word_by_word_equals_the_whole_text(reference):
    r = random.Random(2)
    parts = ["ÀÉß", "It'S", "'llama", "!'s", "x'RE", "a-b", "£", "×", "²", "½", "ª", "<|startoftext|>", "The", "don't", "e-mail", "x.y", "naïve", "日本語", "😀", "3,000", "\x01", "a\x01b", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "​", "﻿", "\x00", "�", "(", "...", "</w>", "<|endoftext|>", "İ", "ﬁ", "é", "é"]
    words = P.WordTokenizer(PATH)
    for _ in range(3000):
        t = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 30)))
        assert words.encode([t])[0].tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


def check_pieces(out, want, window):
    """Pieces cover every document once and in order; sequences are gapless and never too long."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r.id].append(r)
        seqs[r.sequence].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= window
    assert sum(r.length for r in out) == sum(len(x) for xs in want.values() for x in xs)
    for i, xs in want.items():
        ps = sorted(docs[i], key=lambda r: (r.start, r.sequence, r.offset))
        if len(xs) == 1:
            x, at = xs[0], 0
            for p in ps:
                assert p.start == at and p.doc_tokens == len(x)
                assert p.ids_crc32 == zlib.crc32(np.array(x[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(x)
    return seqs


def padding(seqs, window):
    return sum(0 if n == window or n & (n - 1) == 0 else window - n for n in (sum(x for _, x in s) for s in seqs.values()))


@pytest.mark.parametrize("window", [4096, 64])
def test_odd_documents(spark, reference, window):
    want = defaultdict(list)
    for i, t, *_ in rows():
        want[i].append(ids_of(reference, t))
    out = P.pack(odd_docs(spark), PATH, window=window).collect()
    check_pieces(out, want, window)
    assert all(list(r.ids) == [] or zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)


def test_padding_is_small(spark, reference):
    docs = [(k, prose(k, random.Random(k).randint(5, 900))) for k in range(300)]
    out = P.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), PATH, ids=False).collect()
    seqs = check_pieces(out, {k: [ids_of(reference, t)] for k, t in docs}, 4096)
    total = sum(r.length for r in out)
    assert padding(seqs, 4096) < 0.02 * total


def test_empty_table(spark):
    assert P.pack(no_docs(spark), PATH).count() == 0


def brute(nodes, window):
    """The least cost over all subsets of cuts."""
    best = float("inf")
    inner, (end, last) = nodes[:-1], nodes[-1]
    for k in range(len(inner) + 1):
        for chosen in itertools.combinations(inner, k):
            cuts = [0, *(p for p, _ in chosen), end]
            lengths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
            if max(lengths) <= window:
                best = min(best, last + sum(p for _, p in chosen) + sum(0 if n & (n - 1) == 0 else window - n for n in lengths))
    return best


def test_dynamic_programme_is_optimal():
    r = random.Random(5)
    for _ in range(300):
        window = r.choice([8, 12, 16])
        nodes, p = [], 0
        for _ in range(r.randint(1, 10)):
            p += r.randint(1, window)
            nodes.append((p, r.choice([0, 0, 3, 5])))
        ends, cost = P.cut(nodes, window)
        assert cost == brute(nodes, window)
        assert ends[-1] == nodes[-1][0] and set(ends) <= {q for q, _ in nodes}


def stream_of(docs, window, every, **how):
    """The window ends of a stream that looks for final windows after every few documents."""
    s, ends, pieces = P.Stream(window, 0, **how), {}, []
    for k, (n, nodes) in enumerate(docs):
        s.add(k, np.arange(n), nodes)
        if (k + 1) % every == 0:
            pieces += list(s.flush(False))
    pieces += list(s.flush(True))
    for _, _, ids, _, seq, offset in pieces:
        ends[seq] = max(ends.get(seq, 0), offset + len(ids))
    return np.cumsum([ends[k] for k in sorted(ends)]).tolist(), s, pieces


def random_docs(r, window):
    out = []
    for _ in range(r.randint(1, 120)):
        n = r.randint(1, 3 * window)
        inner = sorted(set(r.sample(range(1, n + 1), r.randint(0, min(n, 6)))) | set(range(window // 2, n, window // 2)) - {n})
        out.append((n, [(p, r.choice([2, 9])) for p in inner if p < n]))
    return out


@pytest.mark.parametrize("cost", [0, 3])
def test_windows_that_leave_early_are_those_of_the_whole_stream(cost):
    r = random.Random(8)
    for _ in range(60):
        window = r.choice([8, 16, 32])
        docs = random_docs(r, window)
        nodes, at = [], 0
        for n, inner in docs:
            nodes += [*((at + p, pen) for p, pen in inner), (at + n, 0)]
            at += n
        want, _ = P.cut(nodes, window, cost, tail=True)
        got, s, pieces = stream_of(docs, window, r.randint(1, 9), window_cost=cost, open_windows=10_000)
        assert got == want and s.forced == 0
        assert sum(len(p[2]) for p in pieces) == at


def test_open_windows_are_bounded():
    r = random.Random(9)
    docs = random_docs(r, 16) * 5
    got, s, pieces = stream_of(docs, 16, 3, open_windows=2)
    assert s.forced > 0 and got[-1] == sum(n for n, _ in docs) and max(np.diff([0, *got])) <= 16
    assert [(p[0], p[1]) for p in pieces] == sorted((p[0], p[1]) for p in pieces)


def test_tail_nodes_change_only_the_last_windows():
    """Adding them to the programme gives what it gives with them from the start."""
    r = random.Random(10)
    for _ in range(200):
        window = r.choice([8, 16])
        nodes, p = [], 0
        for _ in range(r.randint(1, 30)):
            p += r.randint(1, window)
            nodes.append((p, r.choice([0, 0, 3])))
        end, rest, q, more = p, p % window, p, dict(nodes)
        for k in range(window.bit_length()):
            if rest >> k & 1:
                q -= 1 << k
                if q > 0:
                    more.setdefault(q, P.HARD_PENALTY)
        assert P.cut(nodes, window, 1, tail=True)[1] == P.cut(sorted(more.items()), window, 1)[1]
        assert P.cut(nodes, window, 1, tail=True)[0][-1] == end


def test_words_that_were_forgotten_are_learnt_again(reference, monkeypatch):
    monkeypatch.setattr(P, "RECENT_WORDS", 20)
    monkeypatch.setattr(P, "RECENT_PARTS", 10)
    words = P.WordTokenizer(PATH)
    for k in range(30):
        t = [prose(k % 7, 60), "", None, f"naïve{k} x{k}.  ", " "]
        for a, b in zip(words.encode(t), t, strict=True):
            assert a.tolist() == reference.encode(b or "", add_special_tokens=False).ids
    assert len(words.words.keys) <= 300
