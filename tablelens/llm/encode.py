"""Piece encoding and decoding by streaming Viterbi (6).

The lattice's columns are those of ``pieces.Transducer``: at each character the
pieces it may lie in, each with its backpointer's last piece. For a merge
vocabulary a path is admissible only if neighbouring pieces are compatible, and
one path survives to every boundary, so the best path is the one that merging gives.

A boundary commits when no surviving piece spans it. All committed boundaries of a
batch are traced back together, each up to the one before. A text above the block
size is read in blocks: at a block's end the backpointer paths of all survivors
(starts at most one maximum piece length back) are followed to the boundary where
they converge, ids up to it are emitted and only the rest is kept with its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm import tokens as _tokens
from tablelens.llm.common import register, table
from tablelens.llm.pieces import SPACE, Transducer, code_points, utf8_extra


#: texts encoded and decoded together
SLICE = 300


class Encoder:
    def __init__(self, tr: Transducer):
        if not tr.t.byte_fallback:
            raise ValueError("the vocabulary has no byte pieces")
        self.tr = tr

    def _lengths(self, path: np.ndarray) -> np.ndarray:
        last = self.tr.last[path]
        return np.where(last >= 0, self.tr.t.length[np.maximum(last, 0)], 1)

    def _trace(self, path: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Marks the characters that end a token, for texts whose last character ends one."""
        is_end = self.tr.single[path]
        is_end[offset[1:][np.diff(offset) > 0] - 1] = True
        length = self._lengths(path)
        floor = np.zeros(len(path), bool)            # first characters: nothing before them in the text
        floor[offset[:-1][np.diff(offset) > 0]] = True
        cur = np.flatnonzero(is_end)
        while len(cur):
            head = cur - length[cur] + 1              # first character of the token
            prev = head[~floor[head]] - 1
            cur = np.unique(prev[~is_end[prev]])
            is_end[cur] = True
        return is_end

    def _ids(self, points: np.ndarray, path: np.ndarray, is_end: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.tr.t
        at = np.flatnonzero(is_end)
        last, p = self.tr.last[path[at]], points[at].astype(np.int64)
        raw = last < 0
        n = np.where(raw, 1 + utf8_extra(points[at]), 1)
        stop = np.cumsum(n)
        ids = np.repeat(np.where(raw, -1, t.ids[np.maximum(last, 0)]), n).astype(np.int32)
        for total in (1, 2, 3, 4):                     # UTF-8 bytes of characters without a piece
            pick = np.flatnonzero(raw & (n == total))
            for k in range(total):
                shift = 6 * (total - 1 - k)
                lead = (0, 0, 0xC0, 0xE0, 0xF0)[total] if k == 0 else 0x80
                byte = lead | (p[pick] >> shift if k == 0 else (p[pick] >> shift) & 0x3F)
                ids[stop[pick] - total + k] = t.byte_ids[byte]
        per_end = np.zeros(len(is_end) + 1, np.int64)
        per_end[at + 1] = n
        return ids, np.cumsum(per_end)[offset]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        block = _tokens.BLOCK
        group, held = [], 0
        for i, t in enumerate([*texts, None]):
            if t is None or held + len(t) > block:
                if group:
                    points, offset = code_points([texts[g] for g in group])
                    chars = self.tr.t.char_of[points]
                    _, _, path = _tokens.read_texts(self.tr, chars, offset, np.zeros(len(group), np.int64), True)
                    ids, cut = self._ids(points, path, self._trace(path, offset), offset)
                    for g, lo, hi in zip(group, cut[:-1], cut[1:]):
                        out[g] = ids[lo:hi]
                group, held = [], 0
            if t is None:
                break
            if len(t) <= block:
                group.append(i)
                held += len(t)
            else:
                out[i] = np.concatenate(list(self.stream(t[k:k + block] for k in range(0, len(t), block))))
        self.tr.trim()
        return out

    def stream(self, parts: Iterator[str]) -> Iterator[np.ndarray]:
        """Ids of one text that arrives in parts, committed as far as all surviving paths agree."""
        tail, state, begun = "", 0, False
        for part in parts:
            if not part:
                continue
            text = tail + ("" if begun else SPACE) + part.replace(" ", SPACE)
            begun = True
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            offset = np.array([0, len(points)], np.int64)
            _, _, path = _tokens.read_texts(self.tr, self.tr.t.char_of[points], offset, np.array([state]), True)
            cut = self._converged(path)
            if cut:
                yield self._emit(points[:cut], path[:cut])
                state = int(path[cut - 1])
            tail = text[cut:]
        if tail:
            points = np.frombuffer(tail.encode("utf-32-le"), np.uint32)
            _, _, path = _tokens.read_texts(self.tr, self.tr.t.char_of[points], np.array([0, len(points)], np.int64),
                                            np.array([state]), True)
            yield self._emit(points, path)

    def _emit(self, points: np.ndarray, path: np.ndarray) -> np.ndarray:
        offset = np.array([0, len(points)], np.int64)
        return self._ids(points, path, self._trace(path, offset), offset)[0]

    def _converged(self, path: np.ndarray) -> int:
        """The last boundary that lies on the backpointer paths of all survivors at the end."""
        n = len(path)
        col = self.tr.cols[path[-1]]
        bounds = {n - int(self.tr.t.depth[node]) for node in col[:, 0] if node >= 0}
        while len(bounds) > 1:
            far = max(bounds)
            bounds.discard(far)
            bounds.add(far - int(self._lengths(path[far - 1:far])[0]))
        return max(0, bounds.pop())


def piece_bytes(model_path: str) -> list[bytes]:
    """The bytes that each id stands for (control pieces: none)."""
    from tablelens.llm.pieces import BYTE, CONTROL, UNKNOWN, read_model
    with open(model_path, "rb") as f:
        return [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
                else p.replace(SPACE, " ").encode() for p, _, k in read_model(f.read())]


def decode_ids(ids, of: list[bytes]) -> str:
    """Text of a list of ids; the space mark set before a text is taken off, broken bytes become U+FFFD."""
    raw = b"".join([of[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    """One Arrow list a text, without Python objects for the ids."""
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    for lo in range(0, len(texts), SLICE):
        yield [t or "" for t in texts.slice(lo, SLICE).to_pylist()]


def encoded(spark: SparkSession, text: Column, model_path: str) -> Column:
    """Ids (array<int>) of a text column; null and empty texts have no ids."""
    tables = spark.sparkContext.broadcast(_tokens.compile_tables(model_path))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(_tokens.machine(tables.value))
        for texts in batches:
            yield _id_lists([i for part in _slices(texts) for i in enc.encode(part)])

    return ids_of(text)


def decoded(spark: SparkSession, ids: Column, model_path: str) -> Column:
    """Text of a column of ids; null ids give null, ids outside the vocabulary raise."""
    of = spark.sparkContext.broadcast(piece_bytes(model_path))

    @F.pandas_udf("string")
    def text_of(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_ids(x.tolist(), of.value) for x in s], dtype=object)

    return text_of(ids)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``piece_ids`` and ``n_pieces``, one row per row; null text: no ids.

    A column of one of those names is replaced. Empty table: empty result. Rows pass through
    as Arrow slices of ``SLICE`` texts, so a task holds the ids of one slice.
    """
    tables = docs.sparkSession.sparkContext.broadcast(_tokens.compile_tables(model_path))
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("piece_ids", "n_pieces")])
    at = [c.lower() for c in kept.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(_tokens.machine(tables.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ids = enc.encode([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, _id_lists(ids), pa.array([len(i) for i in ids], pa.int64())],
                                                 names=[*part.schema.names, "piece_ids", "n_pieces"])

    schema = T.StructType([*kept.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])
    return kept.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, piece_ids, round_trip): ids of each text and whether decoding them gives it back.

    One row per row; null text counts as empty. Both directions run in one Python worker,
    ``SLICE`` texts at a time.
    """
    tables = docs.sparkSession.sparkContext.broadcast((_tokens.compile_tables(model_path), piece_bytes(model_path)))

    @F.arrow_udf("piece_ids array<int>, round_trip boolean")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled, of = tables.value
        enc = Encoder(_tokens.machine(compiled))
        for texts in batches:
            ids, back = [], []
            for part in _slices(texts):
                some = enc.encode(part)
                back += [decode_ids(i.tolist(), of) == t for i, t in zip(some, part)]
                ids += some
            yield pa.StructArray.from_arrays([_id_lists(ids), pa.array(back, pa.bool_())], names=["piece_ids", "round_trip"])

    out = docs.select(F.col(id_col), both(F.col(text_col)).alias("both"))
    return out.select(id_col, F.size("both.piece_ids").cast("long").alias("n_pieces"), "both.piece_ids", "both.round_trip")


@register("op6_encode_decode")
def op6_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and whether decoding them gives the text back."""
    import public_tokenizers
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
