"""A piece vocabulary compiled to a lazily determinised transducer.

Byte-pair merging over pieces has a local description: a segmentation is the
one the merge procedure gives exactly when every two adjacent pieces are
*compatible*, that is, merging never joins symbols across their border. So a
left-to-right reader only has to remember, for every piece it may still be
inside of (at most ``max piece length`` of them), the piece before it and how
many tokens lie before it. That bounded memory is the state:

    column of (vocabulary-trie node, piece on the left, tokens relative to now)

Reading one character moves every entry down the trie. Exactly one entry then
ends on a piece compatible with its left neighbour. This piece is the last
token of the text read so far, and the change in the number of tokens is the
emission on the transition. States with equal columns are one state. New
transitions are computed for all missing (state, character) pairs at once and
kept in an open-addressing table, so the automaton grows with the distinct
contexts met and not with the text. It is dropped and rebuilt when it passes
``max_states`` (between batches only).
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: characters without a piece: one state, their UTF-8 bytes are the tokens
NO_PIECE = -2
_MUL = np.uint64(0x9E3779B97F4A7C15)


class LongMap:
    """Open addressing from non-negative int64 keys to int32 values, whole arrays at a time."""

    def __init__(self, bits: int = 16, width: int = 1):
        self.n, self.width = 0, width
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.vals = np.zeros((1 << bits, self.width), np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is absent."""
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, at, -1)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        mask = (1 << self.bits) - 1
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            k = self.keys[at[todo]]
            hit = k == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (k != -1)]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add distinct keys that are absent."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            live = self.keys != -1
            old_k, old_v, bits = self.keys[live], self.vals[live], self.bits
            while (self.n + len(keys)) * 2 > (1 << bits):
                bits += 1
            self._alloc(bits)
            self._insert(old_k, old_v)
        self._insert(keys, vals.reshape(len(keys), self.width))
        self.n += len(keys)

    def _insert(self, keys: np.ndarray, vals: np.ndarray) -> None:
        at, todo = self._home(keys), np.arange(len(keys))
        mask = (1 << self.bits) - 1
        while len(todo):
            a = at[todo]
            free = np.flatnonzero(self.keys[a] == -1)
            _, first = np.unique(a[free], return_index=True)  # one key a free slot
            win = todo[free[first]]
            self.keys[at[win]] = keys[win]
            self.vals[at[win]] = vals[win]
            lost = np.ones(len(todo), bool)
            lost[free[first]] = False
            todo = todo[lost]
            at[todo] = (at[todo] + 1) & mask

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        s = self.slots(keys)
        return np.where(s >= 0, self.vals[np.maximum(s, 0), 0], default)


def read_model(blob: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of every id."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
    out = []
    for i in range(sp.get_piece_size()):
        kind = (UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i)
                else UNUSED if sp.is_unused(i) else NORMAL)
        out.append((sp.id_to_piece(i), sp.get_score(i), kind))
    return out


def _merge(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The merge procedure on a short symbol list; also the last pair joined."""
    last = None
    while len(symbols) > 1:
        best = min((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if best[0] == 1 << 30:
            break
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2:]
    return symbols, last


class PieceTables:
    """Arrays compiled from a merge vocabulary: trie, pair table and splits. A few MB, bounded by the vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.key = hash(tuple(pieces))
        normal = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER)]
        if any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        order = sorted(normal, key=lambda x: -x[1])
        rank = {p: r for r, (p, _, _) in enumerate(order)}
        chars = sorted({c for p in rank for c in p})
        if any(c not in rank for c in chars):
            raise ValueError("a character inside pieces is no piece itself")
        n = len(order)
        self.ids = np.array([i for _, _, i in order], np.int32)      # rank -> id
        self.length = np.array([len(p) for p, _, _ in order], np.int32)
        self.max_len = int(self.length.max())
        self.n_chars = len(chars)
        self.char_of = np.zeros(0x110000, np.int16)                     # 0: no piece
        for k, c in enumerate(chars):
            self.char_of[ord(c)] = k + 1
        self.space = int(self.char_of[ord(SPACE)])
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.unknown_id = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.byte_fallback = bool((self.byte_ids >= 0).all())
        # time at which a piece is formed (single characters: before all merges) and its two halves
        self.time = np.array([-1 if len(p) == 1 else r for r, (p, _, _) in enumerate(order)], np.int32)
        self.left = np.full(n, -1, np.int32)
        self.right = np.full(n, -1, np.int32)
        alive = np.ones(n, bool)
        self.pairs = LongMap(17)
        keys, vals = [], []
        for r, (p, _, _) in enumerate(order):
            for cut in range(1, len(p)):
                a, b = rank.get(p[:cut]), rank.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    vals.append(r)
            if len(p) > 1:
                whole, last = _merge(list(p), rank)
                if len(whole) == 1:
                    self.left[r], self.right[r] = rank[last[0]], rank[last[1]]
                    if max(self.time[self.left[r]], self.time[self.right[r]]) > r:
                        raise ValueError("a piece is formed before its parts")
                else:
                    alive[r] = False  # merging never forms it
        self.n = n
        self.pairs.put(np.array(keys, np.int64), np.array(vals, np.int32))
        # trie: node 0 is the root; children by node * (chars + 1) + char
        nodes, ends, edges = {"": 0}, [-1], {}
        for r, (p, _, _) in enumerate(order):
            if not alive[r]:
                continue
            for d in range(1, len(p) + 1):
                if p[:d] not in nodes:
                    nodes[p[:d]] = len(ends)
                    ends.append(-1)
                    edges[nodes[p[:d - 1]] * (self.n_chars + 1) + int(self.char_of[ord(p[d - 1])])] = nodes[p[:d]]
            ends[nodes[p]] = r
        self.ends = np.array(ends, np.int32)
        self.depth = np.array([len(s) for s in nodes], np.int32)
        self.children = LongMap(18)
        self.children.put(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.inner = np.zeros(len(ends), bool)
        self.inner[np.array(list(edges), np.int64) // (self.n_chars + 1)] = True
        # no piece holds a space mark after another character: nothing spans such a border
        self.spaced = not any(SPACE in p.lstrip(SPACE) for p in rank)
        self.starts_space = np.array([s.startswith(SPACE) for s in nodes], bool)
        self.ends_space = np.array([p.endswith(SPACE) for p, _, _ in order], bool)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's characters together leaves the border alone.

        Walks back in time: whichever of the two symbols at the border was
        formed later is undone. A pair across the border that could have been
        merged before that moment breaks it. At equal rank the left one is merged first.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero(a >= 0)
        x, y = a[live].astype(np.int64), b[live].astype(np.int64)
        limit = np.full(len(live), 1 << 30, np.int64)
        while len(live):
            joined = self.pairs.get(x * self.n + y, 1 << 30)
            bad = joined < limit
            ok[live[bad]] = False
            tx, ty = self.time[x], self.time[y]
            keep = ~bad & ((tx >= 0) | (ty >= 0))
            live, x, y, tx, ty = live[keep], x[keep], y[keep], tx[keep], ty[keep]
            undo_x = tx > ty
            limit = np.where(undo_x, tx, ty + 1).astype(np.int64)
            x = np.where(undo_x, self.right[x], x)
            y = np.where(undo_x, y, self.left[y])
        return ok


class Transducer:
    """The automaton over one process's texts. State 0: start of a text."""

    def __init__(self, tables: PieceTables, max_states: int = 300_000):
        self.t, self.max_states = tables, max_states
        self.reset()

    def reset(self) -> None:
        self.width = 4                                   # entries a state may hold: grows, at most max_len + 1
        self.n_states = 1
        self.cols = np.full((1024, 4, 3), -1, np.int32)  # (node, left, relative tokens)
        self.cols[0, 0] = (0, -1, 0)
        self.last = np.full(1024, -1, np.int32)          # rank of the last token
        self.single = np.zeros(1024, bool)               # nothing spans this point
        self.single[0] = True
        self.known = {self._name(self.cols[0], 1, -1): 0}
        self.moves = LongMap(16, 2)                      # state * chars + char -> (state, tokens)

    @staticmethod
    def _name(col: np.ndarray, entries: int, last: int) -> bytes:
        return col[:entries].tobytes() + int(last).to_bytes(4, "little", signed=True)

    def trim(self) -> None:
        """Between batches only: forget the automaton when it has grown past its bound."""
        if self.n_states > self.max_states:
            self.reset()

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted token counts (may be negative: a longer piece swallows shorter ones)."""
        keys = state * (self.t.n_chars + 1) + char
        at = self.moves.slots(keys)
        if (at < 0).any():
            self._grow(np.unique(keys[at < 0]))
            at = self.moves.slots(keys)
        v = self.moves.vals[at]
        return v[:, 0].astype(np.int64), v[:, 1]

    def _grow(self, keys: np.ndarray) -> None:
        for lo in range(0, len(keys), 50_000):
            part = keys[lo:lo + 50_000]
            nxt, emit = self._compute(part // (self.t.n_chars + 1), part % (self.t.n_chars + 1))
            self.moves.put(part, np.stack([nxt, emit], 1))

    def _compute(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, m = self.t, len(state)
        col = self.cols[state]
        node, left, rel = col[:, :, 0], col[:, :, 1], col[:, :, 2]
        live = node >= 0
        r, c = np.nonzero(live & (char > 0)[:, None])
        to = t.children.get(node[r, c].astype(np.int64) * (t.n_chars + 1) + char[r])
        r, c, to = r[to >= 0], c[to >= 0], to[to >= 0]
        lf, rl = left[r, c], rel[r, c]
        if t.spaced:  # a piece that opens with a space mark is free of what stands before it
            lf = np.where(t.starts_space[to] & ((lf < 0) | ~t.ends_space[np.maximum(lf, 0)]), -1, lf)
        tok = t.ends[to]
        done = np.flatnonzero(tok >= 0)
        done = done[t.compatible(lf[done], tok[done])]
        emit = np.ones(m, np.int32)
        last = np.full(m, NO_PIECE, np.int32)
        emit[r[done]] = rl[done] + 1
        last[r[done]] = tok[done]
        if ((last == NO_PIECE) & (char > 0)).any():
            raise ValueError("no compatible piece: the vocabulary is not a merge vocabulary")
        keep = t.inner[to]
        r, c, to, lf, rl = r[keep], c[keep], to[keep], lf[keep], rl[keep]
        slot = np.arange(len(r)) - np.searchsorted(r, r) + 1   # entry 0 is the fresh one
        if len(slot) and int(slot.max()) >= self.width:
            pad = np.full((len(self.cols), int(slot.max()) + 1 - self.width, 3), -1, np.int32)
            self.cols = np.concatenate([self.cols, pad], 1)
            self.width = self.cols.shape[1]
        k = self.width
        new = np.full((m, k, 3), -1, np.int32)
        new[r, slot, 0], new[r, slot, 1], new[r, slot, 2] = to, lf, rl - emit[r]
        new[:, 0, 0], new[:, 0, 1], new[:, 0, 2] = 0, np.maximum(last, -1), 0
        alone = new[:, 1, 0] < 0
        nxt = np.empty(m, np.int32)
        entries = np.ones(m, np.int64)
        np.maximum.at(entries, r, slot + 1)
        while self.n_states + m > len(self.cols):
            more = len(self.cols) // 2
            self.cols = np.concatenate([self.cols, np.full((more, k, 3), -1, np.int32)])
            self.last = np.concatenate([self.last, np.full(more, -1, np.int32)])
            self.single = np.concatenate([self.single, np.zeros(more, bool)])
        for i in range(m):
            key = self._name(new[i], entries[i], last[i])
            s = self.known.get(key)
            if s is None:
                s = self.n_states
                self.known[key] = s
                self.cols[s], self.last[s], self.single[s] = new[i], last[i], alone[i]
                self.n_states += 1
            nxt[i] = s
        return nxt, emit


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts (space mark before a non-empty text and for each space) and their offsets."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(m) for m in marked])]).astype(np.int64)


def utf8_extra(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point beyond the first."""
    return (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
