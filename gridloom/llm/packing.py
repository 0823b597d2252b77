"""Operator 7, packing: order-preserving dynamic programming over window cuts.

Documents of a partition form one token stream in their order. Nodes of the
stream are document ends, sentence ends and a coarse grid inside long sentences;
the program chooses nodes to cut at, no further apart than a window, so that
padding plus penalties plus a small cost per window is least. A window of length n
is padded to the full window, unless n is a power of two. The best predecessor under
a padded window is the front of a monotone queue over cost + position; the powers of
two are looked up.

Windows leave when no later token can change them, so the cuts are those of one
programme over the whole stream. Memory is bounded: if more than OPEN_WINDOWS windows
wait for that, the cheapest way so far is taken as it is, which costs the padding of
one window and what the way to its end was dearer.

Defined cases: a null or empty text is the end token alone; repeated rows and
null ids are packed like any row; extra columns are not read; an empty table
gives an empty result; a document longer than a window is cut into pieces that
stand in consecutive windows. Sequences never span partitions: ``sequence`` is
the partition's number times 2^32 plus a count from 0.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
#: Padding tokens that a cut inside a document is worth.
SENTENCE_PENALTY, HARD_PENALTY = 4, 64
#: Sentence ends count if this far apart; longer sentences get a node per GRID tokens.
LEAST_GAP, GRID = 16, 512
#: Padding tokens that a window is worth: of ways with equal padding, that with fewer windows.
WINDOW_COST = 32
#: A partition looks for final windows each time so many have come, and lets so many wait at most.
FLUSH, OPEN_WINDOWS = 64, 1024
#: Words, and parts of words, whose ids a worker remembers: some 30 MB.
RECENT_WORDS, RECENT_PARTS = 250_000, 200_000
#: Texts that are tokenized together.
BATCH_BYTES = 8 << 20
SPACES = re.compile("[\n\t\r]")
#: Texts in which lower case, letters, digits and white space are simple: ASCII and Latin-1 letters.
SAFE = re.compile("[ -~\t\n\rÀ-ÖØ-öø-ÿ]*")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r]+")
PART_OR_BREAK = re.compile(PART.pattern + "|\n")
#: The steps of a tokenizer file that SAFE and PART stand for.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Byte-level BPE writes a byte as a character: printable ones as themselves, the n-th other as 256 + n.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
BYTES = {c: "".join(BYTE[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``at`` of pool, one after the other, and where each one's end."""
    length = size[at]
    end = np.cumsum(length, dtype=np.int64)
    return pool[np.repeat(start[at] - (end - length), length) + np.arange(end[-1] if len(end) else 0)], end


#: Finds the ids of different strings: all of them in one array, and where each one's end.
Learn = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


class Recent:
    """Token ids by string, in arrays: beyond ``size`` strings, those not used for longest leave."""

    def __init__(self, size: int) -> None:
        self.size, self.now = size, 0
        self.keys = pa.array([], pa.large_string())
        self.pool, self.start, self.length, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids_of(self, strings: pa.Array, learn: Learn) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in one array, and where each one's end. learn is asked once for each unknown string."""
        self.now += 1
        at = pc.index_in(strings, value_set=self.keys)
        unknown = strings.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).copy()
        if len(unknown):
            code = unknown.dictionary_encode()
            ids, end = learn(code.dictionary)
            at[at < 0] = code.indices.to_numpy(zero_copy_only=False) + len(self.keys)
            begin = np.concatenate(([0], end[:-1]))
            self.keys = pa.concat_arrays([self.keys, code.dictionary])
            self.start = np.concatenate((self.start, begin + len(self.pool)))
            self.length = np.concatenate((self.length, (end - begin).astype(np.int32)))
            self.used = np.concatenate((self.used, np.zeros(len(end), np.int32)))
            self.pool = np.concatenate((self.pool, ids))
        self.used[at] = self.now
        got = gathered(self.pool, self.start, self.length, at)
        if len(self.keys) > self.size:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: self.size // 2])
            self.pool, end = gathered(self.pool, self.start, self.length, stay)
            self.keys, self.length, self.used = self.keys.take(pa.array(stay)), self.length[stay], self.used[stay]
            self.start = end - self.length
        return got


class WordTokenizer:
    """Ids of whole texts, word by word: this tokenizer never merges across white space.

    The ids of words are remembered and looked up. Where the file's normalizer and
    splitter are the known ones (``KNOWN``), new words of ASCII and Latin-1 letters are
    lower-cased and cut into parts here: runs of letters, digits, runs of marks. Those
    need no normalizer any more, and a tokenizer without one learns new parts in one
    call, split at white space. All other words go through the file's own tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words, self.parts = Recent(RECENT_WORDS), Recent(RECENT_PARTS)
        spec = json.loads(self.model.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known = {k: spec[k] for k in KNOWN} == KNOWN and spec["model"]["end_of_word_suffix"] == "</w>"
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        marks = [i for w, i in vocabulary.items() if w.endswith("</w>") and any(c in ".!?" for c in w) and not any(c.isalnum() for c in w[:-4])]
        self.ends[marks] = True
        if self.known:
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.last = np.zeros_like(self.ends)
            self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    @staticmethod
    def of(path: str) -> WordTokenizer:
        """The worker's own tokenizer for this file."""
        kept = sys.__dict__.setdefault("_gridloom_tokenizers", {})
        if path not in kept:
            kept[path] = WordTokenizer(path)
        return kept[path]

    def simple(self, text: str) -> bool:
        return bool(self.known and SAFE.fullmatch(text) and not any(x in text for x in self.special))

    def split(self, text: str) -> list[str]:
        """The words of a text that is not simple: simple ones in lower case, others behind a space."""
        return [w.lower() if self.simple(w) else " " + w for w in SPACES.sub(" ", text).split(" ") if w]

    def learn_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Parts are told apart again by the one word end of each."""
        plain = pc.string_is_ascii(parts).to_numpy(zero_copy_only=False)
        found, count = [], []
        for some in (parts.filter(pa.array(plain)), parts.filter(pa.array(~plain))):
            for at in range(0, len(some), 20_000):
                few = some.slice(at, 20_000)
                text = " ".join(few.to_pylist())
                ids = np.array(self.plain.encode_batch_fast([text if text.isascii() else text.translate(BYTES)], add_special_tokens=False)[0].ids, dtype="<u4")
                edge = np.flatnonzero(self.last[ids]) + 1
                if len(edge) != len(few):
                    raise ValueError("a part has no single word end")
                found.append(ids)
                count.append(np.diff(edge, prepend=0))
        pool, length = np.concatenate(found), np.concatenate(count)
        # ASCII parts stand first in the pool
        place = np.empty(len(parts), dtype=np.int64)
        place[np.argsort(~plain, kind="stable")] = np.arange(len(parts))
        return gathered(pool, np.cumsum(length) - length, length, place)

    def learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = words.to_pylist()
        odd = [k for k, w in enumerate(texts) if w[:1] == " "]
        plain = texts if not odd else [w for w in texts if w[:1] != " "]
        # all words' parts at once, with a line break after each word
        parts = pa.array(PART_OR_BREAK.findall("\n".join([*plain, ""])), pa.large_string())
        breaks = pc.equal(parts, "\n")
        ids, end = self.parts.ids_of(parts.filter(pc.invert(breaks)), self.learn_parts)
        breaks = np.flatnonzero(breaks.to_numpy(zero_copy_only=False))
        end = np.concatenate(([0], end))[breaks[: len(plain)] - np.arange(len(plain))]
        if not odd:
            return ids, end
        # odd words' ids stand behind the others in the pool
        strange = [np.array(self.model.encode(texts[k][1:], add_special_tokens=False).ids, dtype="<u4") for k in odd]
        length = np.concatenate((np.diff(end, prepend=0), [len(x) for x in strange])).astype(np.int64)
        place = np.empty(len(texts), dtype=np.int64)
        is_odd = np.zeros(len(texts), dtype=bool)
        is_odd[odd] = True
        place[np.argsort(is_odd, kind="stable")] = np.arange(len(texts))
        return gathered(np.concatenate([ids, *strange]), np.cumsum(length) - length, length, place)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids per text. Simple texts are split by Arrow; the ids of all words are then gathered as arrays."""
        plain = [t is None or self.simple(t) for t in texts]
        simple = pc.ascii_split_whitespace(pa.array([(t or "").lower() for t, s in zip(texts, plain, strict=True) if s], pa.large_string()))
        others = pa.array([self.split(t) for t, s in zip(texts, plain, strict=True) if not s], simple.type)
        found = pa.concat_arrays([simple, others])
        ids, end = self.words.ids_of(found.flatten(), self.learn_words)
        edge = np.concatenate(([0], end))[found.offsets.to_numpy()]
        place = np.empty(len(texts), dtype=np.int64)
        place[np.argsort(~np.array(plain, dtype=bool), kind="stable")] = np.arange(len(texts))
        return [ids[edge[k] : edge[k + 1]] for k in place.tolist()]


def inner_nodes(ids: np.ndarray, ends: np.ndarray, grid: int = GRID) -> list[tuple[int, int]]:
    """(position, penalty) of cuts inside one document, positions in (0, len)."""
    out: list[tuple[int, int]] = []
    last = 0
    n = len(ids)
    for p in (np.flatnonzero(ends[ids[:-1]]) + 1).tolist() if n > 1 else ():
        if p - last >= LEAST_GAP:
            if p - last > grid:
                out += [(q, HARD_PENALTY) for q in range(last + grid, p, grid)]
            out.append((p, SENTENCE_PENALTY))
            last = p
    out += [(q, HARD_PENALTY) for q in range(last + grid, n, grid)]
    return out


class Cuts:
    """The cheapest cuts of a stream whose nodes arrive in order.

    The best predecessor under a padded window is the front of a monotone queue over
    cost + position; windows of a power of two have no padding and are looked up.
    """

    def __init__(self, window: int, window_cost: int = 0) -> None:
        self.window, self.window_cost = window, window_cost
        self.powers = [1 << k for k in range(window.bit_length() - 1, -1, -1)]
        self.pos, self.cost, self.back, self.pen = [0], [0], [0], [0]
        self.where = {0: 0}
        self.queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, node), rising

    def add(self, p: int, pen: int) -> None:
        pos, cost, where, queue = self.pos, self.cost, self.where, self.queue
        low = p - self.window
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, at = queue[0]
        best = value - low
        for n in self.powers:
            i = where.get(p - n)
            if i is not None and cost[i] < best:
                best, at = cost[i], i
        best += pen + self.window_cost
        where[p] = len(pos)
        value = best + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, len(pos)))
        pos.append(p)
        cost.append(best)
        self.back.append(at)
        self.pen.append(pen)

    def settled(self, last: int) -> int:
        """The last node that the cheapest ways to all nodes at or behind position ``last`` have in common."""
        j = bisect_left(self.pos, last)
        heap = [-k for k in range(j, len(self.pos))]
        heapify(heap)
        while heap[0] != heap[-1] or len(heap) > 1:
            k = -heappop(heap)
            if not heap or -heap[0] != k:
                heappush(heap, -self.back[k])
            if len(heap) == 1:
                break
        return -heap[0]

    def ends(self, j: int) -> list[int]:
        """The positions where the windows up to node j end."""
        out = []
        while j > 0:
            out.append(self.pos[j])
            j = self.back[j]
        return out[::-1]

    def forget(self, j: int) -> None:
        """Drop all nodes before node j, which all ways lead through."""
        if j:
            self.pos, self.cost, self.pen, self.back = self.pos[j:], self.cost[j:], self.pen[j:], [max(0, k - j) for k in self.back[j:]]
            self.where = {p: k for k, p in enumerate(self.pos)}
            self.queue = deque((v, k - j) for v, k in self.queue if k >= j)

    def add_tail(self) -> None:
        """Add nodes that split what a last window holds into powers of two, and find the ways behind them anew."""
        end, extra = self.pos[-1], []
        p, rest = end, (end - self.pos[0]) % self.window
        for k in range(self.window.bit_length()):
            if rest >> k & 1:
                p -= 1 << k
                if self.pos[0] < p and p not in self.where:
                    extra.append((p, HARD_PENALTY))
        if not extra:
            return
        j = bisect_left(self.pos, extra[-1][0])
        again = sorted(extra + list(zip(self.pos[j:], self.pen[j:], strict=True)))
        for p in self.pos[j:]:
            del self.where[p]
        self.pos, self.cost, self.back, self.pen = self.pos[:j], self.cost[:j], self.back[:j], self.pen[:j]
        self.queue = deque()
        for k in range(bisect_left(self.pos, again[0][0] - self.window), j):
            value = self.cost[k] + self.pos[k]
            while self.queue and self.queue[-1][0] >= value:
                self.queue.pop()
            self.queue.append((value, k))
        for p, pen in again:
            self.add(p, pen)


def cut(nodes: list[tuple[int, int]], window: int = WINDOW, window_cost: int = 0, tail: bool = False) -> tuple[list[int], int]:
    """The cheapest cuts of a stream from 0 to its last node, as end positions of windows, and their cost.

    nodes: (position, penalty), rising, no further apart than a window.
    """
    cuts = Cuts(window, window_cost)
    for p, pen in nodes:
        cuts.add(p, pen)
    if tail:
        cuts.add_tail()
    return cuts.ends(len(cuts.pos) - 1), cuts.cost[-1]


class Stream:
    """Documents in, pieces of final windows out.

    A window leaves once the cheapest ways to every node of the last two windows agree on
    it: whatever follows, it is one of the whole stream's cheapest cuts. ``open_windows``
    bounds what waits for that; beyond it, the way to the last node is taken.
    """

    def __init__(self, window: int, first_sequence: int, window_cost: int = WINDOW_COST, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.sequence, self.open_windows = window, first_sequence, open_windows
        self.docs: deque[list] = deque()  # [id, ids, tokens that have left]
        self.cuts = Cuts(window, window_cost)
        self.length = self.left = self.forced = 0  # tokens that came, tokens that left, cuts without proof

    def add(self, doc_id, ids: np.ndarray, nodes: list[tuple[int, int]]) -> None:
        self.docs.append([doc_id, ids, 0])
        for p, pen in nodes:
            self.cuts.add(self.length + p, pen)
        self.length += len(ids)
        self.cuts.add(self.length, 0)

    def flush(self, final: bool) -> Iterator[tuple]:
        """(id, start, ids, document's tokens, sequence, offset) of the pieces of every window that is final."""
        cuts = self.cuts
        if final:
            cuts.add_tail()
            j = len(cuts.pos) - 1
        else:
            j = cuts.settled(self.length - 2 * self.window)
            if self.length - cuts.pos[j] > self.open_windows * self.window:
                self.forced += 1
                j = len(cuts.pos) - 1
        at = self.left
        for end in cuts.ends(j):
            offset = 0
            while at < end:
                doc = self.docs[0]
                n = min(end - at, len(doc[1]) - doc[2])
                yield doc[0], doc[2], doc[1][doc[2] : doc[2] + n], len(doc[1]), self.sequence, offset
                doc[2] += n
                at += n
                offset += n
                if doc[2] == len(doc[1]):
                    self.docs.popleft()
            self.sequence += 1
        self.left = at
        cuts.forget(j)


def pieces_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text; a row of more is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES)))
        yield b.slice(at, to - at)
        at = to


SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = WINDOW, ids: bool = True, window_cost: int = WINDOW_COST, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece, with the piece's token ids (array<int>) unless ``ids`` is false."""
    penalties = {"window_cost": window_cost, "open_windows": open_windows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stream = Stream(window, (task.partitionId() if task else 0) << 32, **penalties)
        flushed = 0
        words = WordTokenizer.of(tokenizer)
        end = np.array([end_id], dtype="<u4")

        def batch(pieces: Iterator[tuple]) -> pa.RecordBatch:
            rows = list(pieces)
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
            cols += [pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([zlib.crc32(r[2].tobytes()) for r in rows], pa.int64())]
            cols += [pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]
            if ids:
                edges = np.cumsum([0, *(len(r[2]) for r in rows)])
                cols.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([r[2] for r in rows]).astype("<i4")) if rows else pa.array([], pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for part in pieces_of(b):
                for doc_id, got in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    whole = np.concatenate((got, end))
                    stream.add(doc_id, whole, inner_nodes(whole, words.ends, min(GRID, window)))
                    if stream.length - flushed >= FLUSH * window:
                        flushed = stream.length
                        yield batch(stream.flush(False))
        yield batch(stream.flush(True))

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))
