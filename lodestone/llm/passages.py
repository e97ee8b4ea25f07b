"""Fuzzy repeated passages by collinear chaining.

Runs of ``k`` words are hashed, and of every ``window`` consecutive runs the least hash is a seed. A seed
that several documents share is matched with the document that has the least key among them, its leader,
so a passage that thousands share costs one match for each of them and not one for each pair. Texts are read once
and go on as hashes of their words, four bytes each. Where a seed
is crowded in a stretch of a task's texts, that is done there first, and the stretch's leader alone goes on:
a seed that a third of all texts hold moves once for each stretch. Seeds move sorted and in bulk, dealt by
hash into as many buckets as keep each small.
Matches of a document with one leader are chained:
the best chain of matches that ascend in both texts, each match worth its words less a cost for the gap
before it. As the cost is a sum over both texts, the best predecessor is a maximum over a prefix, which a
Fenwick tree keeps. Chains are aligned word by word and cut at gaps that don't agree, and what is long and
alike enough is a passage.

A leader may have only a part of a passage that others share whole, and two leaders a part each. Then a document's
chains fall short, but they lie side by side. So where chains that fell short make a stretch of a passage's length, with passages
beside them, these stretches, and nothing else, are texts of another pass with an order of leaders of its own,
in which documents with the parts alone no longer are; and so on as long as a pass finds words that were in no passage
before. As these are few words, there each document is matched with several leaders of a seed, and where a seed has few
places each with all others, so that few passes do. A stretch goes on only where seeds that weren't compared whole may hold
a passage: elsewhere another order of leaders would compare the same pairs again.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytewords import SPACED
from lodestone.llm.common import discard, released, stored
from lodestone.llm.neardup import _C, mixed

GAP = 0.1
#: Words whose runs are hashed at once.
STRETCH = 1 << 19


#: A random number for each byte; a word's hash is their sum, each times a power of _C by its place in the word.
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _C)
_POWERS = np.multiply.accumulate(np.full(1 << 20, _C))
_INVERSE = np.multiply.accumulate(np.full(1 << 20, pow(int(_C), -1, 1 << 64), np.uint64))


def _powers(known: np.ndarray, n: int) -> np.ndarray:
    return known[:n] if n <= len(known) else np.multiply.accumulate(np.full(n, known[0]))


def hashes_in(data: bytes, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, the same in every process, and where the words begin."""
    b = np.frombuffer(data + b" ", np.uint8)
    word = np.zeros(len(b) + 1, bool)
    word[1:] = SPACED[b]
    edges = np.flatnonzero(word[1:] != word[:-1])  # a word's first byte, and the byte after its last one
    start = edges[::2]
    out = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), block):
        cut = edges[2 * i : 2 * (i + block)]
        first, n = cut[0], int(cut[-1] - cut[0]) + 1
        sums = np.add.reduceat(_OF_BYTE[b[first : first + n]] * _powers(_POWERS, n), cut - first)[::2]
        at = cut[::2] - first
        out[i : i + block] = mixed(sums * _powers(_INVERSE, int(at[-1]) + 1)[at])
    return out, start


def _folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def word_hashes(text: str) -> np.ndarray:
    return hashes_in(_folded(text))[0]


def seeds(h: np.ndarray, k: int = 8, window: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the minimizers of word hashes; of fewer than ``k`` words none."""
    found, _, at = all_seeds(h, np.array([len(h)]), k, window)
    return found, at


def all_seeds(h: np.ndarray, sizes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of several texts whose word hashes stand one after the other: (hashes, numbers of texts, places)."""
    starts = np.cumsum(sizes) - sizes
    text, first, runs = np.repeat(np.arange(len(sizes)), sizes), np.repeat(starts, sizes), np.repeat(np.maximum(sizes - k + 1, 0), sizes)
    g = h.astype(np.uint64)
    for i in range(1, k):
        g[: len(h) - i] = g[: len(h) - i] * _C + h[i:]
    g = mixed(g)
    place = np.arange(len(h)) - first
    picked = np.zeros(len(g), bool)
    if len(g) >= window:
        # A window stands at each place from which so many runs are left; the first of equal ones is its least.
        n = len(g) - window + 1
        least, which = g[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, window):
            less = g[i : n + i] < least
            np.copyto(which, i, where=less)
            np.copyto(least, g[i : n + i], where=less)
        at = np.flatnonzero((place + window <= runs)[:n])
        picked[at + which[at]] = True
    # Texts with fewer runs have one window, of all of them.
    for i in np.flatnonzero((sizes >= k) & (sizes - k + 1 < window)):
        a = starts[i]
        picked[a + g[a : a + sizes[i] - k + 1].argmin()] = True
    at = np.flatnonzero(picked)
    return g[at].view(np.int64), text[at], place[at]


class Fenwick:
    """Prefix maxima over ``n`` places: ``put`` raises a place, ``best`` is the maximum of the first ones."""

    def __init__(self, n: int) -> None:
        self.tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        tree, n = self.tree, len(self.tree)
        while i < n and value > tree[i]:  # the next ones hold all that this one does
            tree[i] = value
            i += i & -i

    def best(self, n: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while n > 0:
            if self.tree[n] > out:
                out = self.tree[n]
            n -= n & -n
        return out


def chains(matches: list[tuple[int, int]], k: int = 8, gap: float = GAP, least: int = 2) -> list[list[tuple[int, int]]]:
    """Disjoint chains of ``least`` matches or more, best first. A chain ascends in both places.

    The score of a chain is k for each match, less ``gap`` for each place passed in either text.
    """
    matches = sorted(set(matches))
    places = {q: i for i, q in enumerate(sorted({q for _, q in matches}))}
    tree = Fenwick(len(places))
    score, before = [0.0] * len(matches), [-1] * len(matches)
    i = 0
    while i < len(matches):
        same = i
        while i < len(matches) and matches[i][0] == matches[same][0]:
            p, q = matches[i]
            value, j = tree.best(places[q])
            gain = value - gap * (p + q)
            score[i], before[i] = (k + gain, j) if gain > 0 else (float(k), -1)
            i += 1
        for j in range(same, i):
            p, q = matches[j]
            tree.put(places[q], (score[j] + gap * (p + q), j))
    used, out = [False] * len(matches), []
    for end in sorted(range(len(matches)), key=lambda j: (-score[j], j)):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(matches[end])
            end = before[end]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


def _between(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        hit = row[:-1] + (b == x)
        row[1:] = np.maximum.accumulate(np.maximum(hit, row[1:]))
    return int(row[-1])


def _reach(a: np.ndarray, b: np.ndarray, slack: int, last: bool = False) -> tuple[int, int]:
    """How far two texts go on alike from their starts, and how many words agree; stops ``slack`` misses below the best.

    The end is where most agrees, or the ``last`` word there that does.
    """
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    best = np.maximum.accumulate(np.maximum(score, 0))
    over = np.flatnonzero(best - score > 2 * slack)
    n = int(over[0]) if len(over) else n
    if not n or not same[:n].any() or not last and score[:n].max() <= 0:
        return 0, 0
    far = int(np.flatnonzero(same[:n])[-1] if last else score[:n].argmax()) + 1
    return far, int(same[:far].sum())


def _blocks(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(start, start in the other text, words) of the equal stretches that a chain's matches lie in.

    Matches of one diagonal are looked at together: the words that they span are compared at once, and runs
    of ``k`` equal words or more are stretches.
    """
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(chain):
        j = i
        while j + 1 < len(chain) and chain[j + 1][0] - chain[j + 1][1] == chain[i][0] - chain[i][1]:
            j += 1
        (p, q), stop = chain[i], chain[j][0] + k
        if out:  # what the stretch before holds already
            over = max(out[-1][0] + out[-1][2] - p, out[-1][1] + out[-1][2] - q, 0)
            p, q = p + over, q + over
        if stop > p:
            same = np.concatenate(([False], a[p:stop] == b[q : q + stop - p], [False]))
            edges = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if e - s >= k or len(edges) == 2:
                    out.append((p + s, q + s, e - s))
        i = j + 1
    return out


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int = 8, least_words: int = 40, least_alike: float = 0.8, slack: int = 3) -> list[tuple[int, int, int, int, int]]:
    """(start, stop) in both texts and the words that agree, for passages of a chain between two arrays of word hashes.

    A chain that is long and alike enough is one passage. Another is cut at gaps: its longest part that is
    so comes first, then the longest ones of what is left before and after it.
    """
    blocks = np.array(_blocks(a, b, chain, k), np.int64).reshape(-1, 3)
    if not len(blocks):
        return []
    p, q, n = blocks.T
    gaps = [(int(p[i] + n[i]), int(p[i + 1]), int(q[i] + n[i]), int(q[i + 1])) for i in range(len(n) - 1)]
    # Words that agree up to the end of each block, gaps included.
    agreed = np.cumsum(n) + np.concatenate(([0], np.cumsum(np.array([_between(a[s:e], b[t:u]) for s, e, t, u in gaps], np.int64))))
    before, after = np.zeros((len(n), 2), np.int64), np.zeros((len(n), 2), np.int64)  # words, of them alike, beside each block
    before[0] = _reach(a[: p[0]][::-1], b[: q[0]][::-1], slack)
    after[-1] = _reach(a[p[-1] + n[-1] :], b[q[-1] + n[-1] :], slack)

    def longest(low: int, high: int) -> tuple[int, int, int, int, int, int] | None:
        """Of blocks ``low`` to ``high``: words of the longest part that is a passage, its first and last block, how far it goes beyond them, words alike."""
        best = None
        for beside in (1, 0):
            for i in range(low, high):
                back, fore = before[i] * beside, after[i:high] * beside
                mine = p[i:high] + n[i:high] - p[i] + back[0] + fore[:, 0]
                other = q[i:high] + n[i:high] - q[i] + back[0] + fore[:, 0]
                alike = agreed[i:high] - agreed[i] + n[i] + back[1] + fore[:, 1]
                fit = np.flatnonzero((np.minimum(mine, other) >= least_words) & (alike >= least_alike * np.maximum(mine, other)))
                if len(fit):
                    j = int(fit[mine[fit].argmax()])
                    if best is None or mine[j] > best[0]:
                        best = int(mine[j]), i, i + j, int(back[0]), int(fore[j, 0]), int(alike[j])
            if best:
                return best
        return None

    def row(found: tuple) -> tuple[int, int, int, int, int]:
        _, i, j, back, fore, alike = found
        return int(p[i]) - back, int(p[j] + n[j]) + fore, int(q[i]) - back, int(q[j] + n[j]) + fore, alike

    # The whole chain first: most are one passage.
    def whole(back: tuple[int, int], fore: tuple[int, int]) -> tuple | None:
        mine, other = (int(x[-1] + n[-1] - x[0] + back[0] + fore[0]) for x in (p, q))
        alike = int(agreed[-1] + back[1] + fore[1])
        return (mine, 0, len(n) - 1, int(back[0]), int(fore[0]), alike) if min(mine, other) >= least_words and alike >= least_alike * max(mine, other) else None

    found = whole(before[0], after[-1])
    if not found and agreed[-1] + before[0, 1] + after[-1, 1] >= least_alike * least_words // 2:
        # Edits near its ends may leave a passage too short; it may go on behind them.
        back, fore = _reach(a[: p[0]][::-1], b[: q[0]][::-1], slack, True), _reach(a[p[-1] + n[-1] :], b[q[-1] + n[-1] :], slack, True)
        found = whole(before[0], fore) or whole(back, after[-1]) or whole(back, fore)
    if found:
        return [row(found)]
    for i, (s, e, t, u) in enumerate(gaps):
        after[i] = _reach(a[s:e], b[t:u], slack)
        far = int(after[i, 0])
        before[i + 1] = _reach(a[s + far : e][::-1], b[t + far : u][::-1], slack)
    out, parts = [], [(0, len(n))]
    while parts:
        low, high = parts.pop()
        found = longest(low, high) if high > low else None
        if found:
            out.append(row(found))
            parts += [(low, found[1]), (found[2] + 1, high)]
    return sorted(out)


def _packer(least_words: int, most: int = 1 << 20):
    """Texts to arrays of 32 bits of their words' hashes, with their lengths; texts too short for a passage go.

    Two given words that differ agree once in four billion. ``most`` bytes of text or one longer text are hashed at once.
    """

    def packed(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> pa.RecordBatch:
        h, start = hashes_in(b" ".join(texts))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        sizes = np.diff(ends, prepend=0)
        kept = np.flatnonzero(sizes >= least_words)
        words = (h[np.repeat(sizes >= least_words, sizes)] >> np.uint64(32)).astype(np.uint32)
        offsets = np.concatenate(([0], np.cumsum(sizes[kept] * 4)))
        words = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(words)])
        rows = pa.array(kept + first, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(sizes[kept], pa.int64()), words], ["node", "id", "w", "h"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, held = [], 0, 0
            for i, t in enumerate(batch.column(2)):
                texts.append(_folded(t.as_py()))
                held += len(texts[-1])
                if held > most or i + 1 == batch.num_rows:
                    yield packed(batch, first, texts)
                    texts, first, held = [], i + 1, 0
            released()

    return pack


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second bytes and so on, compressed, after their count."""
    data = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    x = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(x.reshape(width, n).T).view(kind).reshape(-1)


def _matched(seed: np.ndarray, node: np.ndarray, place: np.ndarray, crowd: int = 2, leaders: int = 1, whole: int = 0) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """For seeds in ascending order, of those with ``crowd`` places or more: (node, leader, places) of all against the first ``leaders`` documents; which places are those of leaders, or not in a crowd; and, where ``whole`` is given, which are of seeds whose documents weren't all compared.

    A leader's place is its first one. Where a seed has ``whole`` places at most, every place is compared with all others.
    Places in both texts are one number, that in the leader below.
    """
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(seed)), bool), seed[1:] != seed[:-1])))
    held = np.diff(np.append(starts, len(seed)))
    many = np.flatnonzero(np.repeat(held >= crowd, held))
    many = many[np.lexsort((place[many], node[many], seed[many]))]  # of one seed, in order of documents and places
    s, n, p = seed[many], node[many], place[many]
    one = np.ones(min(1, len(s)), bool)
    opens = np.concatenate((one, s[1:] != s[:-1]))  # the first place of a seed
    enters = opens | np.concatenate((one, n[1:] != n[:-1]))  # and of each document with it
    firsts, of = np.flatnonzero(enters), np.cumsum(enters) - 1
    group = np.flatnonzero(opens)
    sizes = np.diff(np.append(group, len(s)))
    rank = of - np.repeat(of[group], sizes)  # a document's number in its seed
    goes_on, left = np.ones(len(seed), bool), np.zeros(len(seed), bool)
    leads = enters & (rank < leaders)
    if whole:
        few = np.repeat(sizes <= whole, sizes)
        number = np.arange(len(s)) - np.repeat(group, sizes)  # a place's
        leads |= few
        left[many] = ~few
    goes_on[many[~leads]] = False
    out = []
    for i in range(max(leaders, int(sizes[sizes <= whole].max(initial=0)))):
        at = np.flatnonzero(np.where(few, number > i, (rank >= i) & (i < leaders)) if whole else rank >= i)
        if not len(at):
            break
        lead = np.where(few[at], at - number[at] + i, firsts[np.where(few[at], 0, of[at] - rank[at] + i)]) if whole else firsts[of[at] - rank[at] + i]
        other = at != lead
        at, lead = at[other], lead[other]
        out.append((n[at], n[lead], (p[at].astype(np.int64) << 32) | p[lead]))
    return goes_on, tuple(map(np.concatenate, zip(*out, strict=True))) if out else (n, n, p.astype(np.int64)), left


def _grouped(node: np.ndarray, leader: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches by pair of documents: node, leader, where each pair's matches start (and the end of all), matches in order."""
    order = np.lexsort((m, leader, node))
    node, leader, m = node[order], leader[order], m[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(m)), bool), (node[1:] != node[:-1]) | (leader[1:] != leader[:-1]))))
    return node[starts], leader[starts], np.append(starts, len(m)), m


_SEEDS = "bucket int, seeds binary, nodes binary, texts binary, places binary, node bigint, leader bigint, chains array<array<bigint>>, open array<bigint>"
_MATCHES = "node bigint, leader bigint, m array<bigint>, chains array<array<bigint>>, open array<bigint>"
_PLACES = pa.list_(pa.int64())
_CHAINS = pa.list_(_PLACES)
#: Marks a place whose seed has documents that did not go on.
_MORE = 1 << 31


def _open(node: np.ndarray, place: np.ndarray) -> tuple[pa.Array, pa.ListArray]:
    """Documents, and their places of seeds whose documents weren't all compared."""
    of, _, starts, at = _grouped(node, np.zeros(len(node), np.int64), place)
    return pa.array(of), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at, pa.int64()))


def _seeder(k: int, window: int, gap: float, buckets: int, crowd: int, leaders: int, whole: int):
    """Word hashes to seeds, in bulk by bucket. A seed with ``crowd`` places in a stretch of texts goes on with its leaders; the others' chains are made here.

    A place of such a seed is marked if its documents weren't all compared here.
    """

    def stretch(nodes: list[int], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        of = np.array(nodes, np.int64)
        s, i, p = all_seeds(np.concatenate(words), np.array(list(map(len, words))), k, window)
        # 56 bits: two seeds that are alike by chance cost a look at most, and never make a passage.
        s = (s.view(np.uint64) >> np.uint64(8)).view(np.int64)
        order = np.argsort(s)
        s, i, p = s[order], i[order], p[order]
        goes_on, near, left = _matched(s, of[i], p, crowd, leaders, whole)
        stay = left & ~goes_on
        unmet = _open(of[i[stay]], p[stay]) if whole else None
        s, i, p = s[goes_on], i[goes_on], p[goes_on] | (np.int64(_MORE) * left[goes_on] if whole else 0)
        bucket = (s.view(np.uint64) >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)  # ascends with the seed
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(s) else np.zeros(0, np.int64)
        columns: list[list] = [[], [], [], [], []]
        for a, b in zip(edges, np.append(edges[1:], len(s)), strict=True):
            used, text = np.unique(i[a:b], return_inverse=True)
            steps = np.diff(s[a:b].view(np.uint64), prepend=np.uint64(0))
            for column, value in zip(columns, (int(bucket[a]), _planes(steps), of[used].tobytes(), _planes(text.astype(np.uint32)), _planes(p[a:b].astype(np.uint32))), strict=True):
                column.append(value)
        n = len(edges)
        bulk = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])]
        yield pa.RecordBatch.from_arrays([*bulk, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, _CHAINS), pa.nulls(n, _PLACES)], _SEEDS_NAMES)
        kept, leader, chained = _chained(*_grouped(*near), k, gap)
        n = len(kept)
        spread = lambda x: pa.array((mixed(x.view(np.uint64)) % np.uint64(buckets)).astype(np.int32))
        none = lambda n: [pa.nulls(n, pa.binary()) for _ in range(4)]
        yield pa.RecordBatch.from_arrays([spread(kept), *none(n), pa.array(kept), pa.array(leader), chained, pa.nulls(n, _PLACES)], _SEEDS_NAMES)
        if unmet:
            n = len(unmet[0])
            yield pa.RecordBatch.from_arrays([spread(unmet[0].to_numpy()), *none(n), unmet[0], pa.nulls(n, pa.int64()), pa.nulls(n, _CHAINS), unmet[1]], _SEEDS_NAMES)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, words, held = [], [], 0
        most = 4 * STRETCH // max(4, leaders)  # each place of a crowd has as many matches as there are leaders
        for batch in batches:
            for node, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes.append(node)
                words.append(np.frombuffer(h.as_buffer(), np.uint32))
                held += len(words[-1])
                if held >= most:
                    yield from stretch(nodes, words)
                    nodes, words, held = [], [], 0
            released()
        if nodes:
            yield from stretch(nodes, words)

    return seed


_SEEDS_NAMES = [x.split()[0] for x in _SEEDS.split(", ")]


def _meeter(leaders: int, whole: int):
    """Seeds of one bucket to matches, by pair of documents, and the places of seeds whose documents weren't all compared; chains pass."""
    names = ["node", "leader", "m", "chains", "open"]

    def meet(table: pa.Table) -> pa.Table:
        near = table.filter(pc.is_valid(table.column("node"))).select(["node", "leader", "chains", "open"])
        bulk = table.filter(pc.is_valid(table.column("seeds")))
        s, n, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row in zip(*(bulk.column(c) for c in ("seeds", "nodes", "texts", "places")), strict=True):
            steps, nodes, texts, places = (x.as_py() for x in row)
            s.append(np.cumsum(_numbers(steps, "<u8"), dtype=np.uint64).view(np.int64))
            n.append(np.frombuffer(nodes, np.int64)[_numbers(texts, "<u4")])
            p.append(_numbers(places, "<u4").astype(np.int64))
        s, n, p = np.concatenate(s), np.concatenate(n), np.concatenate(p)
        released()
        order = np.argsort(s)
        s, n, p = s[order], n[order], p[order]
        more, p = p >= _MORE, p % _MORE
        _, found, left = _matched(s, n, p, 2, leaders, whole)
        node, leader, starts, m = _grouped(*found)
        met = pa.table([pa.array(node), pa.array(leader), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(m)), pa.nulls(len(node), _CHAINS), pa.nulls(len(node), _PLACES)], names)
        near = pa.table([near.column("node"), near.column("leader"), pa.nulls(len(near), _PLACES), near.column("chains"), near.column("open")], names)
        if not whole:
            return pa.concat_tables([met, near])
        left |= np.isin(s, s[more])
        of, places = _open(n[left], p[left])
        rest = pa.table([of, pa.nulls(len(of), pa.int64()), pa.nulls(len(of), _PLACES), pa.nulls(len(of), _CHAINS), places], names)
        return pa.concat_tables([met, near, rest])

    return meet


def _split(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both texts, which travel as one number."""
    return pairs >> 32, pairs & 0xFFFFFFFF


def _chained(node: np.ndarray, leader: np.ndarray, starts: np.ndarray, m: np.ndarray, k: int, gap: float) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of matches by pair, in order: the pairs with a chain, and their chains. A chain's matches cover two runs' words or more."""

    def covered(p: np.ndarray) -> int:
        return k + int(np.minimum(np.diff(p), k).sum())

    p, q = _split(m)
    kept, rows, links, flat = [], [0], [0], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(np.diff(starts) > 1):
        a, b = starts[i], starts[i + 1]
        x, y = p[a:b], q[a:b]
        if covered(np.sort(x)) < 2 * k:
            continue
        steps, other = np.diff(x), np.diff(y)
        # On one diagonal with gaps that a match pays for, the best chain has all matches.
        if (steps == other).all() and (steps > 0).all() and steps.max() * 2 * gap <= k:
            found = [m[a:b]]
        else:
            found = []
            for c in chains(list(zip(x.tolist(), y.tolist(), strict=True)), k, gap, 2):
                z = np.array(c, np.int64)
                if covered(z[:, 0]) >= 2 * k:
                    found.append((z[:, 0] << 32) | z[:, 1])
        if found:
            kept.append(i)
            flat += found
            links += (links[-1] + np.cumsum([len(c) for c in found])).tolist()
            rows.append(len(links) - 1)
    inner = pa.ListArray.from_arrays(pa.array(links, pa.int32()), pa.array(np.concatenate(flat), pa.int64()))
    return node[kept], leader[kept], pa.ListArray.from_arrays(pa.array(rows, pa.int32()), inner)


def _chainer(k: int, gap: float):
    """Matches of pairs of documents to chains."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            node, leader = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(list(_chained(*_grouped(node, leader, np.asarray(lists.flatten())), k, gap)), ["node", "leader", "chains"])

    return chain


def _aligner(k: int, least_words: int, least_alike: float):
    names = ("start", "stop", "other_start", "other_stop", "agree")

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names])))
    def aligned(a: pa.Array, b: pa.Array, found: pa.Array) -> pa.Array:
        out, ends = array("i"), [0]
        for i in range(len(a)):
            x, y = (np.frombuffer(v[i].as_buffer(), np.uint32) for v in (a, b))
            for links in found[i].values:
                p, q = _split(np.asarray(links.values))
                passages = align(x, y, list(zip(p.tolist(), q.tolist(), strict=True)), k, least_words, least_alike)
                for passage in passages:
                    out.extend(passage)
                # What of the chain is in no passage falls short: -1 words agree.
                left = (p >= 0) if not passages else ~np.any([(p >= a) & (p + k <= b) for a, b, *_ in passages], axis=0)
                if np.count_nonzero(left) > 1:
                    out.extend((int(p[left].min()), int(p[left].max()) + k, int(q[left].min()), int(q[left].max()) + k, -1))
            ends.append(len(out) // len(names))
        table = np.array(out, np.int32).reshape(-1, len(names))
        places = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, j])) for j in range(len(names))], list(names))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)

    return aligned


def _inside(spans: list[tuple[int, int]], slack: int):
    """Whether a span lies in one of ``spans``, up to ``slack`` words at an end."""
    spans = sorted(spans)
    starts, far = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def inside(start: int, stop: int) -> bool:
        i = bisect_right(starts, start + slack)
        return i > 0 and far[i - 1] >= stop - slack

    return inside


def _holds(a: int, b: int, places: np.ndarray, k: int, least_words: int) -> bool:
    """Whether runs at ``places``, in order, cover half the words of a passage's length somewhere from ``a`` to ``b``."""
    x = places[np.searchsorted(places, a) : np.searchsorted(places, b)] - a
    if len(x) * k * 2 < least_words:
        return False
    covered = np.zeros(max(b - a, least_words) + k, np.int64)
    for i in range(k):
        covered[x + i] = 1
    total = np.concatenate(([0], np.cumsum(covered)))
    return 2 * int((total[least_words:] - total[:-least_words]).max()) >= least_words


def _stretches(k: int, least_words: int, apart: int):
    """Spans (start, stop, short) of one text, and passages found before, to the stretches (start, stop) of a passage's length that chains which fell short make, with passages beside them, if open places can hold a passage there; and whether a passage is new. Where no open places are given, every stretch may go on."""
    found = T.StructType([T.StructField("s", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))), T.StructField("new", T.BooleanType())])

    @F.arrow_udf(found)
    def joined(spans: pa.Array, before: pa.Array, places: pa.Array) -> pa.Array:
        out, new = [], []
        for row, old, more in zip(spans.to_pylist(), before.to_pylist(), places, strict=True):
            done = [(x["start"], x["stop"]) for x in row if not x["short"]]
            known, looked_at = _inside([(x["start"], x["stop"]) for x in old], apart), _inside(done, apart)
            new.append(not all(known(*x) for x in done))
            held: list[list[int]] = []
            for x in sorted(row, key=lambda x: (x["start"], x["stop"])):
                # A chain that fell short inside one passage has been looked at.
                open_ = x["short"] and not looked_at(x["start"], x["stop"])
                if held and x["start"] <= held[-1][1] + apart:
                    held[-1][1], held[-1][2] = max(held[-1][1], x["stop"]), held[-1][2] or open_
                else:
                    held.append([x["start"], x["stop"], open_])
            more = np.sort(np.asarray(more.values)) if more.is_valid else None
            goes_on = lambda a, b, more=more: more is None or _holds(a, b, more, k, least_words)
            out.append([{"start": a, "stop": b} for a, b, open_ in held if open_ and b - a >= least_words and goes_on(a, b)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(out, kind), pa.array(new, pa.bool_())], ["s", "new"])

    return joined


def _sides(rows: DataFrame) -> DataFrame:
    """Spans (n, start, stop, agree) of both texts of each row."""
    return rows.select(F.col("_node").alias("n"), "start", "stop", "agree").union(rows.select("_leader", "other_start", "other_stop", "agree"))


def _tasks(words: int) -> int:
    """How many tasks the Python functions of a pass over so many words take at most: the few words of a later pass are no work for hundreds."""
    return max(12, -(-words // (1 << 15)))


def _left(rows: DataFrame, before: DataFrame | None, places: DataFrame | None, size: int, k: int, least_words: int) -> DataFrame:
    """n, s, new: by text, the stretches that a pass leaves for another, and whether it found passages that lie in none found before.

    ``places`` are those, by text, of seeds whose documents weren't all compared. A passage that is still to be found has hardly
    other seeds: two that were compared, side by side, would have made a chain, in whatever order of leaders. So where such
    places don't cover half of a passage's length, another pass has nothing to find.
    """
    spans = _sides(rows).withColumn("kind", F.lit("now"))
    if before is not None:
        spans = spans.union(_sides(before).where("agree >= 0").withColumn("kind", F.lit("before")))
    if places is not None:
        spans = spans.union(places.select("n", F.explode(F.col("open").cast("array<int>")).alias("start"), F.lit(0), F.lit(0), F.lit("open")))
    kind, span = F.col("kind"), F.struct("start", "stop", (F.col("agree") < 0).alias("short"))
    sets = [F.collect_set(F.when(kind == "now", span)).alias("s"), F.collect_set(F.when(kind == "before", F.struct("start", "stop"))).alias("b"), F.collect_set(F.when(kind == "open", F.col("start"))).alias("p")]
    spans = spans.groupBy("n").agg(*sets).where(F.size("s") > 0).coalesce(_tasks(size))
    more = F.lit(None).cast("array<int>") if places is None else F.col("p")
    found = spans.select("n", _stretches(k, least_words, 2 * k)(F.col("s"), F.col("b"), more).alias("x"))
    return stored(found.select("n", "x.s", "x.new").where((F.size("s") > 0) | F.col("new")), "stretches")


def _pass(texts: DataFrame, size: int, k: int, window: int, least_words: int, least_alike: float, crowd: int, bucket: int, leaders: int, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """One pass over (node, id, h) of ``size`` words, with leaders by node: passages, and with -1 words that agree what of chains fell short; and, if ``whole``, by text the places of seeds whose documents weren't all compared."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A place has ``whole`` matches at most, or as many as leaders.
    buckets = min(max(parts, -(-size * 2 * max(1, whole, leaders) // ((window + 1) * bucket))), 1 << 30)

    rows = texts.select("node", "h").mapInArrow(_seeder(k, window, GAP, buckets, max(crowd, whole + 1) if whole else crowd, leaders, whole), _SEEDS)
    met = stored(rows.groupBy("bucket").applyInArrow(_meeter(leaders, whole), _MATCHES).coalesce(_tasks(size)), "matches")
    far = met.where("m is not null").groupBy("node", "leader").agg(F.flatten(F.collect_list("m")).alias("m"))
    far = far.coalesce(_tasks(size)).mapInArrow(_chainer(k, GAP), "node bigint, leader bigint, chains array<array<bigint>>")
    found = met.where("chains is not null").select("node", "leader", "chains").union(far)
    places = None
    if whole:
        shifted = F.transform("open", lambda p: p + F.col("id.o"))
        places = stored(met.where("open is not null").select("node", "open").join(texts.select("node", "id"), "node").select(F.col("id.n").alias("n"), shifted.alias("open")).coalesce(_tasks(size)), "open")

    # Alike on both sides, so the words move once for both joins.
    packs = texts.groupBy("node").agg(F.first("id").alias("id"), F.first("h").alias("h"))
    mine = packs.select("node", F.col("id").alias("own"), F.col("h").alias("a"))
    other = packs.select(F.col("node").alias("leader"), F.col("id").alias("other"), F.col("h").alias("b"))
    pairs = found.join(mine, "node").join(other, "leader").coalesce(_tasks(size))
    pairs = pairs.select("own", "other", F.explode(_aligner(k, least_words, least_alike)(F.col("a"), F.col("b"), F.col("chains"))).alias("x"))
    shift = lambda side, *names: [(F.col(f"x.{n}") + F.col(f"{side}.o")).alias(n) for n in names]
    out = pairs.select(
        F.col("own.i").alias("doc_id"), *shift("own", "start", "stop"), F.col("other.i").alias("other_id"), *shift("other", "other_start", "other_stop"), "x.agree",
        F.col("own.n").alias("_node"), F.col("other.n").alias("_leader"),
    )
    out = stored(out.distinct().coalesce(_tasks(size)), "passages")
    discard(met)
    return out, places


def repeated_passages(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 4, window: int = 2, least_words: int = 40, least_alike: float = 0.8, crowd: int = 16, bucket: int = 1 << 20, leaders: int = 16,
) -> DataFrame:
    """doc_id, start, stop, other_id, other_start, other_stop, agree: passages that stand in another place too.

    Places are word numbers, ``stop`` excluded; ``agree`` counts words that are alike in order. A passage has
    ``least_words`` words in both texts, of which the share ``least_alike`` agrees. ``other_id`` is the
    passage's leader, the document with the least hash of (id, text) among those with the seeds; a passage of
    n documents gives n - 1 rows with one leader, or more with a few leaders where its copies differ, where leaders have parts of it, or of one stretch of about half a million words share a seed and have a leader of their
    own: which leaders are named depends there on how the texts are dealt. Repeats inside one document are found where that document leads, against their first place.

    Rows alike in id and text are one document; ids are of any type. Null and empty texts, and texts of fewer
    than ``least_words`` words, have no passages; an empty table has none. Other columns don't matter,
    whatever their names. Very long texts are read whole. No seed, however common, is left out: ``window`` +
    k - 1 equal words hold one that both texts have. ``bucket`` is the number of seeds that one task holds at
    once, about. ``leaders`` documents of each seed are compared with its others in the passes after the first, or all if it has three times as many places at most.
    """
    node = F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(node.alias("node"), F.struct(F.col(doc_id).alias("i"), F.lit(0).alias("o"), node.alias("n")).alias("id"), F.col(text).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()
    texts = stored(texts.mapInArrow(_packer(least_words), f"node bigint, id {kind}, w bigint, h binary"), "words")
    size = texts.agg(F.sum("w").alias("w")).first()["w"] or 0
    out, now, before, written = None, texts, None, [texts]
    for turn in count(1):
        few = (leaders, 3 * leaders) if turn > 1 else (1, 0)
        rows, places = _pass(now, size, k, window, least_words, least_alike, crowd, bucket, *few)
        found = rows.where("agree >= 0").drop("_node", "_leader")
        out = found if out is None else out.union(found)
        left = _left(rows, before, places, size, k, least_words)
        written += [left] if places is None else [left, places]
        before = rows if before is None else before.union(rows)
        length = F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
        words = left.agg(F.sum(length).alias("w"), F.sum(16 + 8 * F.size("s")).alias("size"), F.max("new").alias("new")).first()
        if not words["w"] or turn > 1 and not words["new"]:
            break
        size = words["w"]
        spans = left.where(F.size("s") > 0).select("n", F.explode("s").alias("x"))
        spans = F.broadcast(spans) if words["size"] <= 32 << 20 else spans
        # With as many words around a stretch as seeds may leave out at an end.
        parts = texts.join(spans, F.col("node") == F.col("n")).withColumn("o", F.greatest(F.lit(0), F.col("x.start") - 2 * k))
        parts = parts.select("node", F.col("id.i").alias("i"), "o", F.substr("h", 4 * F.col("o") + 1, 4 * (F.col("x.stop") + 2 * k - F.col("o"))).alias("h")).dropDuplicates(["node", "o"])
        now = parts.select(F.xxhash64("node", "o", F.lit(turn)).alias("node"), F.struct("i", "o", F.col("node").alias("n")).alias("id"), "h")
        now = stored(now.coalesce(_tasks(size)), "stretch-words")
        written.append(now)
    out = stored(out.distinct(), "repeated") if turn > 1 else out
    discard(*written)
    return out
