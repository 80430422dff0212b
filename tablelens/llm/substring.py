"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds (10).

Seeds are minimizers: of every ``WINDOW`` neighbouring runs of ``K`` words the one with the
smallest hash. Any shared run of WINDOW + K - 1 words shares a seed. Each seed that
occurs in several documents links every occurrence to its first one (smallest document
key), so a passage in n documents gives n - 1 links a seed and never all pairs.

The shared seeds of a document and one owner are chained: seeds on one diagonal join to
segments, and a Fenwick tree over the owner's positions finds each segment's best
predecessor within ``MAX_GAP`` words on both sides under linear gap costs. The words of both sides of a chain are then aligned:
equal words along segments, edit distance inside the gaps between them, and X-drop
extension at both ends. Passages of ``MIN_WORDS`` words or more with ``SIMILARITY`` of their
words equal are reported. Two seeds of a pair are enough to start; where the X-drop extension
is no passage, the widest one around the chain with ``SIMILARITY`` is taken, and a chain without one
is cut at its widest gap and tried again.

Owners are chosen seed by seed, so a third document that quotes parts of a passage can take
its seeds. Stretches where all seeds are shared are therefore read again: every run of
``MIN_WORDS`` words there that no reported passage covers is joined, whole, to the first
place of the smallest document that has it: the uncovered runs go out first, and of the
other runs only those that equal one of them. No run of ``MIN_WORDS`` equal words is left
unreported, wherever its seeds went and however often a document repeats it.

Documents move twice, for those runs and as the texts that chains ask for. A seed's places
stream through one task, none of them held; hot owners are plain joins, which adaptive
execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import broadcast_if_small, fresh, register, release, table, written

K, WINDOW = 5, 4
MIN_WORDS, SIMILARITY = 50, 0.8
GAP_COST, MAX_GAP = 0.05, 40       # score lost per skipped word (both sides); words a chain may skip at once
PAD, GRID = MIN_WORDS, 32           # words fetched beyond a chain; fetched spans begin and end on this grid
PIECE = 1 << 18                     # bytes or words hashed at a time
GROUP = 1 << 16                     # bytes of short texts hashed together
RUN_KEYS = 1_000_000                # uncovered runs that are broadcast (8 bytes each) after they have been counted; more are joined by a shuffle

_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: a random number for each byte, A-Z as a-z
_BYTE = np.random.default_rng(10).integers(0, 1 << 64, 256, np.uint64)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def _range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range, by differences of a running polynomial modulo 2^64."""
    up, down = _powers(max(PIECE, len(values) + 1))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, each cut behind white space."""
    lo, raw = 0, np.frombuffer(data, np.uint8)
    while lo < len(data):
        hi = lo + PIECE
        while hi < len(data):
            stop = np.flatnonzero(_SPACE[raw[hi:hi + PIECE]])
            if len(stop):
                hi += int(stop[0]) + 1
                break
            hi += PIECE
        yield data[lo:hi]
        lo = hi


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each lower-cased word of a whole text."""
    found = [np.zeros(0, np.uint64)]
    for piece in _pieces((text or "").encode()):
        raw = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_SPACE[raw]
        edge = np.diff(inside)
        found.append(_range_hashes(_BYTE[raw], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
    return np.concatenate(found)


def hashed_texts(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, words, offsets): ``word_hashes`` of the texts from:to one after another, text i's at offsets[i]:offsets[i + 1].

    Short texts are hashed together, GROUP bytes at a time: a few steps a group and not a text.
    """
    group, lo, held = [], 0, 0
    for i, t in enumerate([*texts, None]):
        data = (t or "").encode()
        if group and (i == len(texts) or held + len(data) > GROUP):
            raw = np.frombuffer(b" ".join([*group, b""]), np.uint8)
            inside = np.zeros(len(raw) + 2, np.int8)
            inside[1:-1] = ~_SPACE[raw]
            edge = np.diff(inside)
            start = np.flatnonzero(edge == 1)
            stop = np.cumsum([len(g) + 1 for g in group])
            yield lo, i, _range_hashes(_BYTE[raw], start, np.flatnonzero(edge == -1)), np.append(0, np.searchsorted(start, stop))
            group, held = [], 0
        if i == len(texts):
            return
        if not group:
            lo = i
        if len(data) > GROUP:
            words = word_hashes(t)
            yield i, i + 1, words, np.array([0, len(words)])
        else:
            group.append(data)
            held += len(data) + 1


def _words_of(texts: pd.Series) -> Iterator[np.ndarray]:
    """``word_hashes`` of each text."""
    for first, end, words, offset in hashed_texts(texts.tolist()):
        yield from (words[offset[i]:offset[i + 1]] for i in range(end - first))


def wide_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """As ``run_hashes``, with a few steps a word whatever ``size``."""
    n = max(0, len(words) - size + 1)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        at = np.arange(hi - lo)
        out[lo:hi] = _range_hashes(words[lo:hi + size - 1], at, at + size)
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += words[j:j + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def seeds_of(words: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of the minimizers of word sequences, text i's words at offset[i]:offset[i + 1]; none below K words.

    The n-th occurrence of one k-mer in a text has its own hash, so repeated lines and
    runs of one word match their like in order. From the second on it has the first one's
    hash too, so a passage that a document holds twice is found twice.
    """
    n_runs = np.maximum(np.diff(offset) - K + 1, 0)
    text = np.repeat(np.arange(len(n_runs)), n_runs)
    begin = np.cumsum(n_runs) - n_runs
    at = np.arange(len(text)) - begin[text]
    h = run_hashes(words, K)[at + offset[text]]
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    # a position is chosen if it equals the minimum of any window of its text that holds it; a text below WINDOW runs is one window
    n = len(h)
    w = min(WINDOW, n)
    low = h.copy()[: n - w + 1]
    for j in range(1, w):
        np.minimum(low, h[j:n - w + 1 + j], out=low)
    whole = text[w - 1:] == text[: n - w + 1]
    best = np.zeros(n, bool)
    for j in range(w):
        best[j:n - w + 1 + j] |= (h[j:n - w + 1 + j] == low) & whole
    for i in np.flatnonzero((n_runs > 0) & (n_runs < w)):
        part = h[begin[i]:begin[i] + n_runs[i]]
        best[begin[i]:begin[i] + n_runs[i]] = part == part.min()
    kept = np.flatnonzero(best)
    h, text, at = h[kept], text[kept], at[kept]
    nth = np.zeros(len(h), np.uint64)
    ranked = np.sort(h)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        some = np.flatnonzero(np.isin(h, twice))
        order = some[np.argsort(h[some], kind="stable")]
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
        start = np.flatnonzero(first)
        nth[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    again = nth > 0
    h = np.concatenate([h + nth * np.uint64(0xD1B54A32D192ED03), h[again]])
    return h.view(np.int64), np.concatenate([text, text[again]]), np.concatenate([at, at[again]]).astype(np.int32)


def _seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for x in batches:
        for lo in range(0, len(x), 1000):
            part = x.iloc[lo:lo + 1000]
            doc, out = part["doc"].to_numpy(np.int64), []
            for first, end, words, offset in hashed_texts(part["text"].tolist()):
                seed, text, pos = seeds_of(words, offset)
                out.append((seed, doc[first:end][text], pos))
            yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("seed", "doc", "pos"))})


def _link_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every place of a seed that two documents or more hold, with its first one; rows come sorted by (seed, doc, pos).

    A seed's rows stream by: only the owner's are kept until another document comes.
    """
    rest, known = None, None                   # the last seed: rows of its owner alone, or (seed, owner, opos)
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        if not len(x):
            continue
        seed, doc, pos = (x[c].to_numpy() for c in ("seed", "doc", "pos"))
        new = np.ones(len(x), bool)
        new[1:] = seed[1:] != seed[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        owner, opos = doc[first], pos[first]
        if known is not None and known[0] == seed[0]:
            owner[0], opos[0] = known[1:]
        many = doc[last] != owner
        rest, known = (None, (seed[-1], owner[-1], opos[-1])) if many[-1] else (x.iloc[first[-1]:], None)
        size = last - first + 1
        held = np.repeat(many, size)
        yield pd.DataFrame({"doc": doc[held], "owner": np.repeat(owner, size)[held], "pos": pos[held], "opos": np.repeat(opos, size)[held]})


class ReachTree:
    """Best (value, item) among the entries at most ``reach`` behind a point on both axes.

    Fenwick trees over blocks of reach + 1 positions of y, one upwards and one downwards, so a
    reach is the end of one block and the beginning of the next. A node keeps a heap;
    entries that x has left behind leave it when they come up. x may only grow.
    """

    def __init__(self, reach: int):
        self.reach, self.size = reach, reach + 1
        self.nodes: dict[tuple[int, int, int], list] = {}

    def put(self, x: int, y: int, value: float, item: int) -> None:
        block, i = divmod(y, self.size)
        for side, at in enumerate((i + 1, self.size - i)):
            while at <= self.size:
                heappush(self.nodes.setdefault((side, block, at), []), (-value, item, x))
                at += at & -at

    def top(self, x: int, y: int) -> tuple[float, int]:
        block, i = divmod(y, self.size)
        best = (1e18, -1, 0)
        for side, of, at in ((0, block, i + 1), (1, block - 1, self.size - i - 1)):
            while at > 0:
                heap = self.nodes.get((side, of, at))
                while heap and heap[0][2] < x - self.reach:
                    heappop(heap)
                if heap and heap[0] < best:
                    best = heap[0]
                at &= at - 1
        return -best[0], best[1]


def segments(doc: np.ndarray, owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, owner, (x, y, length)) of runs of seeds on one diagonal that overlap or nearly touch, for all pairs at once."""
    diag = x - y
    order = np.lexsort((x, diag, owner, doc))
    doc, owner, x, diag = doc[order], owner[order], x[order], diag[order]
    new = np.ones(len(x), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (diag[1:] != diag[:-1]) | (x[1:] - x[:-1] > K + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    return doc[first], owner[first], np.stack([x[first], x[first] - diag[first], x[last] - x[first] + K], 1)


def apart(doc: np.ndarray, owner: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the segments in an order where those that a chain could join stand together, and where each such set begins.

    Sets of a pair lie over MAX_GAP words of x or of y apart. Segments of a set keep their order.
    """
    order = np.lexsort((owner, doc))
    of = np.zeros(len(order), np.int64)            # each segment's set: at first its pair
    of[order[1:]] = np.cumsum((np.diff(doc[order]) != 0) | (np.diff(owner[order]) != 0))
    for axis in (0, 1, 0, 1):
        order = np.lexsort((seg[:, axis], of))
        at = (of[order] << 32) + seg[order, axis]
        reach = np.maximum.accumulate(at + seg[order, 2])   # a set's furthest end so far: word positions are below 2^31
        of[order] = np.append(0, np.cumsum(at[1:] - reach[:-1] > MAX_GAP))
    order = np.argsort(of, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(of[order]) != 0))


def chains(seg: np.ndarray) -> list[list[int]]:
    """Best collinear chains of segments, each segment in one chain at most."""
    n = len(seg)
    if n == 1:
        return [[0]]
    begin = [(x, y, x + length, y + length) for x, y, length in seg.tolist()]
    order = sorted(range(n), key=begin.__getitem__)
    end_order = sorted(range(n), key=lambda i: begin[i][2])
    tree, score, prev, at = ReachTree(MAX_GAP), [0.0] * n, [-1] * n, 0
    for j in order:
        x, y, ex, _ = begin[j]
        score[j] = float(ex - x)
        while at < n and begin[end_order[at]][2] <= x:
            i = end_order[at]
            _, _, ix, iy = begin[i]
            tree.put(ix, iy, score[i] + GAP_COST * (ix + iy), i)
            at += 1
        value, i = tree.top(x, y)
        gain = value - GAP_COST * (x + y)
        if i >= 0 and gain > 0:
            score[j], prev[j] = score[j] + gain, i
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = prev[j]
        if chain:
            out.append(chain[::-1])
    return out


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], work) -> Iterator[pd.DataFrame]:
    """``work`` on frames of whole groups; rows come sorted by the keys."""
    rest = None
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        if not len(x):
            continue
        key = x[keys].to_numpy()
        cut = int(np.flatnonzero((key != key[-1]).any(1)).max(initial=-1)) + 1
        rest = x.iloc[cut:].reset_index(drop=True)
        if cut:
            yield work(x.iloc[:cut])
    if rest is not None and len(rest):
        yield work(rest)


def _chain_columns(doc: np.ndarray, owner: np.ndarray, px: np.ndarray, py: np.ndarray) -> list[tuple]:
    """Chains of two seeds or more, whatever their length, of whole pairs of a document and an owner."""
    if not len(doc):
        return []
    doc, owner, seg = segments(doc, owner, px, py)
    order, first = apart(doc, owner, seg)
    size = np.diff(np.append(first, len(order)))
    one = order[first[size == 1]]
    one = one[seg[one, 2] > K]                     # one seed alone is none
    x, y, n = seg[one].T
    out = list(zip(doc[one].tolist(), owner[one].tolist(), x.tolist(), (x + n).tolist(), y.tolist(), (y + n).tolist(),
                   seg[one].astype(np.int32)))
    for lo, n in zip(first[size > 1], size[size > 1]):
        at = order[lo:lo + n]
        part = seg[at]
        for chain in chains(part):
            if len(chain) == 1 and part[chain[0], 2] == K:
                continue
            c = part[chain]
            x0, x1 = int(c[0, 0]), int(c[-1, 0] + c[-1, 2])
            if x1 - x0 > K:
                out.append((int(doc[at[0]]), int(owner[at[0]]), x0, x1, int(c[0, 1]), int(c[-1, 1] + c[-1, 2]), c.ravel().astype(np.int32)))
    return out


def _stretches(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, a, b): word ranges that can hold a shared run of MIN_WORDS words, from all shared seeds of whole documents.

    Inside a shared run no two neighbouring seeds are over WINDOW apart and all are shared.
    """
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    a, b = np.maximum(pos[first] - WINDOW + 1, 0), pos[last] + K + WINDOW - 1
    wide = b - a >= MIN_WORDS
    return doc[first][wide], a[wide], b[wide]


def _shared_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains and, marked as such, stretches (from x0 to x1) of each document; its shared seeds come together, bounded by its length."""

    def work(x: pd.DataFrame) -> pd.DataFrame:
        doc, owner, px, py = (x[c].to_numpy(np.int64) for c in ("doc", "owner", "pos", "opos"))
        other = doc != owner
        out = _chain_columns(doc[other], owner[other], px[other], py[other])
        none = np.zeros(0, np.int32)
        whole = [(d, d, a, b, 0, 0, none) for d, a, b in zip(*(c.tolist() for c in _stretches(doc, px)))]
        rows = pd.DataFrame(out + whole, columns=["doc", "owner", "x0", "x1", "y0", "y1", "seg"])
        return rows.assign(stretch=np.arange(len(rows)) >= len(out))

    yield from _whole_groups(batches, ["doc"], work)


def _runs_in(words: np.ndarray, spans) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the runs of MIN_WORDS words in the spans."""
    h = wide_hashes(words, MIN_WORDS)
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(p["a"], min(p["b"], len(words)) - MIN_WORDS + 1) for p in spans)])
    return h[at].view(np.int64), at.astype(np.int32)


def _uncovered(at: np.ndarray, n_words: int, covered) -> np.ndarray:
    """Which runs of MIN_WORDS words have a word that is in no covered span."""
    bare = np.ones(n_words, bool)
    for p in covered if covered is not None else ():
        bare[p["start"]:p["end"]] = False
    bare = np.append(0, np.cumsum(bare))
    return bare[at + MIN_WORDS] > bare[at]


def _cover(doc: np.ndarray, owner: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Fewest of the ranges [x0, x1) of each (doc, owner) that hold all their words (a repeated word matches at many places)."""
    order = np.lexsort((x1, x0, owner, doc))
    keep, group, best = [], None, -1           # best: the range that reaches furthest beyond the last one kept
    for i, of, lo, hi in zip(order, zip(doc[order], owner[order]), x0[order], x1[order]):
        if of != group:
            keep += [best] if best >= 0 else []
            group, end, best = of, lo, -1
        if best >= 0 and lo > end:
            keep.append(best)
            end, best = x1[best], -1
        if lo > end:
            end = lo
        if hi > (x1[best] if best >= 0 else end):
            best = i
    return np.array(keep + ([best] if best >= 0 else []), int)


def _fewest_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages of a document and an owner without those whose words others of them hold (chains of one passage meet when extended)."""

    def work(x: pd.DataFrame) -> pd.DataFrame:
        return x.iloc[_cover(*(x[c].to_numpy(np.int64) for c in ("doc", "owner", "start", "end")))]

    yield from _whole_groups(batches, ["doc", "owner"], work)


def _exact_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shared runs that follow each other on one diagonal as chains of one segment; rows come sorted by (doc, owner, diagonal, pos)."""

    def work(x: pd.DataFrame) -> pd.DataFrame:
        doc, owner = x["doc"].to_numpy(np.int64), x["owner"].to_numpy(np.int64)
        px, py = x["pos"].to_numpy(np.int64), x["opos"].to_numpy(np.int64)
        new = np.ones(len(x), bool)
        new[1:] = ((doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(px - py) != 0) | (np.diff(px) > MIN_WORDS))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        first, last = first[keep := _cover(doc[first], owner[first], px[first], px[last] + MIN_WORDS)], last[keep]
        x0, y0, size = px[first], py[first], px[last] - px[first] + MIN_WORDS
        return pd.DataFrame({"doc": doc[first], "owner": owner[first], "x0": x0, "x1": x0 + size, "y0": y0, "y1": y0 + size,
                             "seg": list(np.stack([x0, y0, size], 1).astype(np.int32))})

    yield from _whole_groups(batches, ["doc", "owner"], work)


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in an alignment of two short runs (longest common subsequence)."""
    if not len(a) or not len(b):
        return 0
    at: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << j
    # a row of the table in one number: bit j is 0 where it rises from j to j + 1
    full = flat = (1 << len(b)) - 1
    for w in a.tolist():
        hit = flat & at.get(w, 0)
        flat = ((flat + hit) | (flat - hit)) & full
    return len(b) - flat.bit_count()


def _reach(equal: np.ndarray) -> int:
    """How far an X-drop extension (+1 equal, -2 not) goes."""
    if not len(equal):
        return 0
    total = np.cumsum(np.where(equal, 1, -2))
    stop = np.flatnonzero(total < np.maximum.accumulate(total) - 8)
    total = total[: stop[0]] if len(stop) else total
    return int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0


def _within(a: np.ndarray, b: np.ndarray, x: int, y: int, xe: int, ye: int, core: int) -> list[tuple[int, int, int, int, int]]:
    """The widest passage around an aligned core of ``core`` equal words that has ``SIMILARITY``; it ends on equal words or with the core."""
    n, m = min(x, y), min(len(a) - xe, len(b) - ye)
    back, on = (a[x - n:x] == b[y - n:y])[::-1], a[xe:xe + m] == b[ye:ye + m]
    size = max(xe - x, ye - y)
    # words above what SIMILARITY asks for, for each end; ends on unequal words don't count
    gain_b, gain_o = (np.where(np.append(True, e), np.append(0, np.cumsum(e - SIMILARITY)), -np.inf) for e in (back, on))
    best = np.maximum.accumulate(gain_o[::-1])[::-1]
    reach = np.searchsorted(-best, core - SIMILARITY * size + gain_b + 1e-9, side="right") - 1
    total = np.where((reach >= 0) & np.isfinite(gain_b), np.arange(len(gain_b)) + reach, -1)
    i = int(np.argmax(total))
    if total[i] < 0 or size + total[i] < MIN_WORDS:
        return []
    j = int(reach[i])
    return [(x - i, xe + j, y - i, ye + j, core + int(back[:i].sum()) + int(on[:j].sum()))]


def align(a: np.ndarray, b: np.ndarray, seg: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Passages (a start, a end, b start, b end, equal words) of a chain of segments on word arrays a and b.

    The X-drop extension stands if it is a passage, else the widest one with ``SIMILARITY`` is taken.
    """
    seg = seg.copy()
    x, y = int(seg[0, 0]), int(seg[0, 1])
    n = min(x, y)
    back = _reach((a[x - n:x] == b[y - n:y])[::-1])
    x0, y0 = x - back, y - back
    xe, ye = int(seg[-1, 0] + seg[-1, 2]), int(seg[-1, 1] + seg[-1, 2])
    n = min(len(a) - xe, len(b) - ye)
    on = _reach(a[xe:xe + n] == b[ye:ye + n])
    x1, y1 = xe + on, ye + on
    size = max(x1 - x0, y1 - y0)
    core = 0
    for i, (sx, sy, sl) in enumerate(seg):
        core += int((a[sx:sx + sl] == b[sy:sy + sl]).sum())
        if i + 1 < len(seg):
            core += _matches(a[sx + sl:seg[i + 1, 0]], b[sy + sl:seg[i + 1, 1]])
    equal = core + int((a[x0:x] == b[y0:y]).sum()) + int((a[xe:x1] == b[ye:y1]).sum())
    if size >= MIN_WORDS and equal >= SIMILARITY * size:
        return [(x0, x1, y0, y1, equal)]
    wide = _within(a, b, x, y, xe, ye, core)
    if wide or len(seg) == 1:
        return wide
    gap = np.maximum(seg[1:, 0] - seg[:-1, 0] - seg[:-1, 2], seg[1:, 1] - seg[:-1, 1] - seg[:-1, 2])
    cut = int(np.argmax(gap)) + 1
    return align(a, b, seg[:cut]) + align(a, b, seg[cut:])


_CHAIN = "doc long, owner long, x0 int, x1 int, y0 int, y1 int, seg array<int>"
_PASSAGE = "array<struct<start:int,end:int,ostart:int,oend:int,equal:int>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str):
    """A document's key: rows equal in id and text are one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, doc_id, owner, other_id, start, end, ostart, oend, equal): passages of ``doc`` that ``owner`` has too.

    Positions count words, ``end`` is exclusive. The owner is the document with the smallest
    key among those that share a passage's seeds. Null texts and texts below
    ``MIN_WORDS`` have none; rows equal in id and text are one document; ids may be
    null. Empty table: empty result.
    """
    rows = docs.select(_keyed(docs, id_col, text_col).alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seeds = rows.where("text IS NOT NULL").select("doc", "text").mapInPandas(_seed_rows, "seed long, doc long, pos int")
    linked = (seeds.repartition("seed").sortWithinPartitions("seed", "doc", "pos")
              .mapInPandas(_link_rows, "doc long, owner long, pos int, opos int"))
    # sorted by one number alone: the order inside a document is made beside the chains
    shared = written(linked.repartition("doc").sortWithinPartitions("doc").mapInPandas(_shared_rows, f"{_CHAIN}, stretch boolean"))
    chained = shared.where("NOT stretch").drop("stretch")
    stretches = shared.where("stretch").select("doc", F.col("x0").alias("a"), F.col("x1").alias("b"))
    kind = docs.schema[id_col].dataType
    found = written(_aligned(rows, chained, kind))
    both = found.unionByName(_aligned(rows, _exact_chains(rows, stretches, found), kind))
    # ids travel as text: a pandas column of whole numbers with nulls would lose digits
    text = both.withColumns({c: F.col(c).cast("string") for c in ("doc_id", "other_id")})
    fewest = text.repartition("doc").sortWithinPartitions("doc", "owner", "start").mapInPandas(_fewest_rows, text.schema)
    return fewest.withColumns({c: F.col(c).cast(kind) for c in ("doc_id", "other_id")})


def _gathered(runs: DataFrame) -> np.ndarray:
    """The only column of a counted frame of longs, sorted, on the driver: it comes as bytes, not as a row a number."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"keys": [x.iloc[:, 0].to_numpy(np.int64).tobytes()]})

    packed = runs.mapInPandas(pack, "keys binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["keys"], np.int64) for r in packed)]))


def _exact_chains(rows: DataFrame, stretches: DataFrame, found: DataFrame) -> DataFrame:
    """Chains of the runs of MIN_WORDS equal words that ``found`` leaves uncovered, wherever their seeds were linked to."""
    covered = found.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("covered"))
    # disjoint ranges of a document: bounded by its length
    asked = written(stretches.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")).join(covered, "doc", "left"))

    source = rows.join(broadcast_if_small(asked), "doc").select("doc", "text", "spans", "covered")

    def runs(open_only: bool, keys=None) -> DataFrame:
        def run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for lo in range(0, len(x), 500):
                    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)]
                    part = x.iloc[lo:lo + 500]
                    for (doc, _, spans, covered), words in zip(part.itertuples(index=False), _words_of(part["text"])):
                        run, at = _runs_in(words, spans)
                        keep = np.ones(len(at), bool)
                        if open_only:
                            keep = _uncovered(at, len(words), covered)
                        elif keys is not None:
                            at_key = np.searchsorted(keys.value, run)
                            keep = np.append(keys.value, 0)[at_key] == run
                            keep &= at_key < len(keys.value)
                        out.append((run[keep], np.full(int(keep.sum()), doc, np.int64), at[keep]))
                    yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("run", "doc", "pos"))})

        return source.mapInPandas(run_rows, "run long, doc long, pos int")

    opened = written(runs(True).distinct())
    wanted = written(opened.select("run").distinct())
    if wanted.count() <= RUN_KEYS:
        keys = _gathered(wanted)
        alike = runs(False, rows.sparkSession.sparkContext.broadcast(keys))
    else:
        alike = runs(False).join(wanted, "run", "left_semi")
    owned = alike.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("own")).select(
        "run", F.col("own.doc").alias("owner"), F.col("own.pos").alias("opos"))
    left = opened.join(owned, "run").where("doc <> owner").select("doc", "owner", "pos", "opos")
    ordered = left.repartition("doc").sortWithinPartitions("doc", "owner", F.col("pos") - F.col("opos"), "pos")
    return written(ordered.mapInPandas(_exact_rows, _CHAIN))


def _aligned(rows: DataFrame, chained: DataFrame, kind) -> DataFrame:
    """The passages of chains, as ``passages`` gives them."""

    def low(c):
        return (F.floor(F.greatest(F.col(c) - PAD, F.lit(0)) / GRID) * GRID).cast("int")

    def high(c):
        return (F.ceil((F.col(c) + PAD) / GRID) * GRID).cast("int")

    asked = chained.select("*", low("x0").alias("xa"), high("x1").alias("xb"), low("y0").alias("ya"), high("y1").alias("yb"))
    spans = (asked.select("doc", F.col("xa").alias("a"), F.col("xb").alias("b"))
             .unionByName(asked.select(F.col("owner").alias("doc"), F.col("ya").alias("a"), F.col("yb").alias("b"))).distinct())
    # distinct grid spans of a document: bounded by its length, whatever the number of chains
    wanted = broadcast_if_small(written(spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for lo in range(0, len(x), 500):
                out = []
                part = x.iloc[lo:lo + 500]
                for (doc, doc_id, _, of), words in zip(part.itertuples(index=False), _words_of(part["text"])):
                    words = words.view(np.int64)
                    out += [(doc, doc_id, s["a"], s["b"], words[s["a"]:s["b"]]) for s in of]
                yield pd.DataFrame(out, columns=["doc", "doc_id", "a", "b", "words"])

    words = written(rows.join(wanted, "doc").select("doc", F.col("doc_id").cast("string").alias("doc_id"), "text", "spans")
                    .mapInPandas(cut_out, "doc long, doc_id string, a int, b int, words array<long>").dropDuplicates(["doc", "a", "b"]))

    @F.pandas_udf(_PASSAGE)
    def aligned(wx: pd.Series, wy: pd.Series, xa: pd.Series, ya: pd.Series, seg: pd.Series) -> pd.Series:
        out = []
        for a, b, x, y, s in zip(wx, wy, xa, ya, seg):
            s = np.asarray(s, np.int64).reshape(-1, 3) - np.array([x, y, 0])
            out.append([{"start": p[0] + x, "end": p[1] + x, "ostart": p[2] + y, "oend": p[3] + y, "equal": p[4]}
                        for p in align(np.asarray(a), np.asarray(b), s)])
        return pd.Series(out, dtype=object)

    left = words.select("doc", F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("words").alias("wx"), F.col("doc_id").cast(kind).alias("doc_id"))
    right = words.select(F.col("doc").alias("owner"), F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("words").alias("wy"),
                         F.col("doc_id").cast(kind).alias("other_id"))
    both = asked.join(left, ["doc", "xa", "xb"]).join(right, ["owner", "ya", "yb"])
    return (both.select("doc", "doc_id", "owner", "other_id", F.explode(aligned("wx", "wy", "xa", "ya", "seg")).alias("p"))
            .select("doc", "doc_id", "owner", "other_id", "p.start", "p.end", "p.ostart", "p.oend", "p.equal"))


def cut_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (and the white space after each)."""
    import re
    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    drop = np.zeros(len(starts), bool)
    for a, b in spans:
        drop[a:min(b, len(starts) - 1)] = True
    out = [text[:starts[0]]]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (~drop[:-1]).astype(np.int8), [0]])))
    for lo, hi in zip(edges[::2], edges[1::2]):
        out.append(text[starts[lo]:starts[hi]])
    return "".join(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut from all documents but its owner; a text left without words goes."""
    found = written(passages(docs, id_col, text_col))
    key, spans = fresh(docs.columns, "doc", "spans")
    per = found.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias(spans)).withColumnRenamed("doc", key)

    @F.pandas_udf("string")
    def cut(text: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else cut_passages(t, [(p["start"], p["end"]) for p in s]) for t, s in zip(text, of)],
                         dtype=object)

    # not deterministic for Spark alone: else the filter below cuts every text a second time, in a second Python worker a task
    cut = cut.asNondeterministic()
    marked = docs.withColumn(key, _keyed(docs, id_col, text_col)).join(broadcast_if_small(written(per)), key, "left")
    changed = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(spans)))
    out = marked.withColumn(text_col, changed).where(F.col(spans).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns)


@register("op10_repeated_passages")
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.greatest(F.col("end") - F.col("start"), F.col("oend") - F.col("ostart"))
    return found.select("doc_id", "other_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"),
                        F.col("ostart").alias("other_start"), F.col("oend").alias("other_end"), F.col("equal").alias("equal_words"),
                        (F.col("equal") / size).alias("similarity"))
