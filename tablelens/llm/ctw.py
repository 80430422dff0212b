"""Language-model scores by context-tree weighting (9).

A text's stream is its lower-cased words joined by spaces and one end byte. Every byte is
eight binary decisions; the decision after a bit prefix has its own context tree over
the ``DEPTH`` bytes before it. Each node mixes its Krichevsky-Trofimov estimate with its
children's product, half and half, so all depths are weighted by how well they code
the training texts. The trees then stay fixed and give each byte's probability.

Everything runs on counts of distinct (context, byte) grams, never on positions:

1. Texts are dealt into blocks of about ``BLOCK_BYTES``. A block counts its grams and words
   and sends one row per distinct one.
2. Counts are summed, each key with the list of its blocks. Grams are dealt by their last two context bytes, which holds whole
   subtrees together; the nodes above (at most 256 * 255 + 255) are mixed on the driver and
   sent back. Each distinct gram gets its log probability, each word its base value.
3. Every block gets the values of its own grams and words back and adds them up per text.

So the model is never in one place and no task holds more than a block or a share of the
distinct grams: a block's texts stay packed and are read ``CHUNK_BYTES`` at a time, a
share is worked on in whole subtrees of about ``SHARE_GRAMS`` grams. A block
holds its texts whole, however long, and all rows equal in id and text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import held_out, register, table, written
from tablelens.llm.pieces import LongMap

DEPTH, TOP = 5, 2                 # bytes of context; levels 0 .. TOP-1 are mixed on the driver
BLOCK_BYTES, CHUNK_BYTES = 14_000_000, 1_000_000
SHARE_GRAMS = 500_000
END = b"\n"
HELD_OUT_FOLDS = 10
LN_HALF = float(np.log(0.5))


def stream_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5 (Stirling's series after eight steps up)."""
    y = x + 8
    up = np.log(x)
    for k in range(1, 8):
        up += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - up


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - 2 * 0.5723649429247001


def grams_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams (DEPTH context bytes, then the byte) at every byte of the streams, and each stream's length."""
    pad = END * DEPTH
    size = np.array([len(s) for s in streams], np.int64)
    raw = np.frombuffer(pad + pad.join(streams), np.uint8).astype(np.int64)
    key = np.zeros(len(raw) - DEPTH, np.int64)
    for d in range(DEPTH + 1):
        key = (key << 8) | raw[d:len(raw) - DEPTH + d]
    real = np.ones(len(key), bool)
    between = np.cumsum(size + DEPTH)[:-1] - DEPTH           # where the next stream's padding ends a gram
    for d in range(DEPTH):
        real[between + d] = False
    return key[real], size


def _slices(docs: pa.Table) -> Iterator[tuple[list[list[bytes]], np.ndarray]]:
    """The words of each text and which texts are held out, for about CHUNK_BYTES at a time."""
    group, held, size = [], [], 0
    for batch in docs.select(["text", "held"]).to_batches(max_chunksize=256):
        for text, out in zip(batch.column(0), batch.column(1)):
            words = stream_words(text.as_py())
            n = sum(map(len, words))
            if group and size + n > CHUNK_BYTES:
                yield group, np.array(held, bool)
                group, held, size = [], [], 0
            group.append(words)
            held.append(out.as_py())
            size += n
    if group:
        yield group, np.array(held, bool)


def _streams(texts: list[list[bytes]]) -> list[bytes]:
    return [b" ".join(w) + END for w in texts]


def word_key(word: bytes) -> int:
    """A negative number (grams are not): 63 bits of XXH64 tell the words of a corpus apart."""
    import xxhash
    return (xxhash.xxh64_intdigest(word) >> 1) - (1 << 63)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([np.zeros(0), *(p[1] for p in parts)]), len(keys))


def _count_block(docs: pa.Table) -> pa.Table:
    """One row per distinct gram and word of a block with its count in the training texts."""
    grams, words = [], []
    for texts, held in _slices(docs):
        for of, counts in (([w for w, h in zip(texts, held) if not h], 1), ([w for w, h in zip(texts, held) if h], 0)):
            if of:
                k, n = np.unique(grams_of(_streams(of))[0], return_counts=True)
                grams.append((k, n * counts))
                seen = Counter(chain.from_iterable(of))
                seen[END] = len(of)
                words.append((np.fromiter(map(word_key, seen), np.int64, len(seen)),
                              np.fromiter(seen.values(), np.int64, len(seen)) * counts))
    parts = [_counted(grams), _counted(words)]
    key = np.concatenate([p[0] for p in parts])
    block = np.full(len(key), docs["block"][0].as_py(), np.int32)
    return pa.table({"block": block, "key": key, "n": np.concatenate([p[1] for p in parts]).astype(np.int64)})


class Level:
    """Nodes of one bit position at one depth: key (context bytes, bit prefix), counts, ln KT, ln weighted."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        self.kt = log_kt(n0, n1)
        self.mix = self.kt if below is None else LN_HALF + np.logaddexp(self.kt, below)

    def stay(self) -> np.ndarray:
        """Share of the node's own estimate in its mixture."""
        return np.exp(np.minimum(LN_HALF + self.kt - self.mix, 0.0))

    def one(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)


def _context(gram: np.ndarray, depth: int) -> np.ndarray:
    return (gram >> 8) & ((1 << (8 * depth)) - 1)


def _levels(gram: np.ndarray, n: np.ndarray, bit: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Levels DEPTH .. TOP of one bit position over whole subtrees; each gram's node in every level; the grams' bits."""
    byte = gram & 255
    prefix, value = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
    levels, places, below, child = [], [], None, None
    for depth in range(DEPTH, TOP - 1, -1):
        key, at = np.unique(_context(gram, depth) << 8 | prefix, return_inverse=True)
        n0 = np.bincount(at, n * (1 - value), len(key))
        n1 = np.bincount(at, n * value, len(key))
        if levels:
            first = np.zeros(len(levels[-1].key), np.int64)
            first[child] = at                                  # a node's parent: any of its grams tells
            below = np.bincount(first, levels[-1].mix, len(key))
        levels.append(Level(key, n0, n1, below))
        places.append(at)
        child = at
    return levels, places, value


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts in whole subtrees, about SHARE_GRAMS at a time; rows come sorted by their last TOP context bytes."""
    key, n = np.zeros(0, np.int64), np.zeros(0)
    for x in batches:
        key, n = np.append(key, x["key"].to_numpy(np.int64)), np.append(n, x["n"].to_numpy(np.float64))
        if len(key) >= SHARE_GRAMS:
            near = _context(key, TOP)
            cut = int(np.flatnonzero(near != near[-1]).max(initial=-1)) + 1
            if cut:
                yield key[:cut], n[:cut]
                key, n = key[cut:], n[cut:]
    if len(key):
        yield key, n


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of depth TOP, summed under their parents of depth TOP - 1."""
    for gram, n in _subtrees(batches):
        for bit in range(8):
            top = _levels(gram, n, bit)[0][-1]
            up = (top.key >> 8 & ((1 << 8 * (TOP - 1)) - 1)) << 8 | (top.key & 255)
            key, at = np.unique(up, return_inverse=True)
            yield pd.DataFrame({"key": key, "n0": np.bincount(at, top.n0), "n1": np.bincount(at, top.n1), "below": np.bincount(at, top.mix)})


def _top_levels(rows: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, stay, one) of depths TOP - 1 .. 0, from one row per node of depth TOP - 1."""
    key = np.array([r["key"] for r in rows], np.int64)
    order = np.argsort(key)
    key = key[order]
    n0, n1, below = (np.array([r[c] for r in rows], np.float64)[order] for c in ("n0", "n1", "below"))
    out = []
    for depth in range(TOP - 1, -1, -1):
        level = Level(key, n0, n1, below)
        out.append((key, level.stay(), level.one()))
        if depth:
            key, at = np.unique((key >> 8 & ((1 << 8 * (depth - 1)) - 1)) << 8 | (key & 255), return_inverse=True)
            n0, n1, below = np.bincount(at, n0), np.bincount(at, n1), np.bincount(at, level.mix)
    return out


def _gram_values(tops):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for gram, n in _subtrees(batches):
            total = np.zeros(len(gram))
            for bit in range(8):
                levels, places, value = _levels(gram, n, bit)
                one = levels[0].one()[places[0]]
                for level, at in zip(levels[1:], places[1:]):
                    stay = level.stay()[at]
                    one = stay * level.one()[at] + (1 - stay) * one
                prefix = (1 << bit) | ((gram & 255) >> (8 - bit))
                for depth, (key, stay, node_one) in zip(range(TOP - 1, -1, -1), tops.value):
                    at = np.searchsorted(key, _context(gram, depth) << 8 | prefix)
                    one = stay[at] * node_one[at] + (1 - stay[at]) * one
                total += np.log10(np.where(value == 1, one, 1 - one))
            yield pd.DataFrame({"key": gram, "x": total})

    return run


def _score_block(base_of):
    """Adds up the values of each text's grams and words. ``base_of``: a word's log10 base probability from its count."""

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        keys, x = values["key"].to_numpy(), values["x"].to_numpy()
        order = np.argsort(keys)
        keys, x = keys[order], x[order]
        split = int(np.searchsorted(keys, 0))
        n, base = x[:split], base_of(x[:split])
        gram_values, grams = x[split:], LongMap(16)
        grams.put(keys[split:], np.arange(len(keys) - split, dtype=np.int32))
        parts = []
        for texts, _ in _slices(docs):
            distinct = list({END}.union(*texts))
            place = dict(zip(distinct, np.searchsorted(keys[:split], np.fromiter(map(word_key, distinct), np.int64, len(distinct))).tolist()))
            size = np.array([len(w) + 1 for w in texts], np.int64)
            at = np.fromiter(map(place.__getitem__, chain.from_iterable([*w, END] for w in texts)), np.int64, int(size.sum()))
            first = np.cumsum(size) - size
            key, n_bytes = grams_of(_streams(texts))
            score = np.add.reduceat(gram_values[grams.get(key)], np.cumsum(n_bytes) - n_bytes)
            parts.append((size, np.add.reduceat((n[at] > 0).astype(np.int64), first), n_bytes, np.add.reduceat(base[at], first), score))
        sums = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
                for i, t in enumerate((np.int64, np.int64, np.int64, np.float64, np.float64))]
        return pa.table([docs["doc"], docs["held"], *map(pa.array, sums)],
                        names=["doc", "held", "n_tokens", "n_known", "n_bytes", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Counts come from the rows that ``is_held_out`` leaves. Null texts are empty: their
    stream is the end byte alone. Without training rows every estimate is that of no
    counts. Empty table: empty result.
    """
    kind = docs.schema[id_col].dataType
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    # the id goes through Python as text, so nulls and large ids stay what they are
    dealt = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"), is_held_out.alias("held")).withColumn(
        "block", F.pmod(F.xxhash64("doc", "text"), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy("block").applyInArrow(_count_block, "block int, key long, n long")
    # a list holds a key's blocks, never its rows: as long as the number of blocks at most
    totals = written(counts.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")))
    words, grams = totals.where("key < 0"), totals.where("key >= 0").select("key", "n")
    n_train, distinct = words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    n_train = n_train or 0
    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    grams = grams.repartition(near).sortWithinPartitions(near)
    rows = (grams.mapInPandas(_roots, "key long, n0 double, n1 double, below double")
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).collect())   # at most 256 * 255 rows
    tops = docs.sparkSession.sparkContext.broadcast(_top_levels(rows))
    gram_values = grams.mapInPandas(_gram_values(tops), "key long, x double").join(totals.select("key", "blocks"), "key")
    values = gram_values.select("blocks", "key", "x").unionByName(
        words.select("blocks", "key", F.col("n").cast("double").alias("x")))
    values = values.select(F.explode("blocks").alias("block"), "key", "x")
    smooth = n_train + 0.1 * (distinct + 1)
    scored = dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        _score_block(lambda n: np.log10((n + 0.1) / smooth)),
        "doc string, held boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    return scored.select(F.col("doc").cast(kind).alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known",
                         F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
                         (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


@register("op9_language_model")
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, held_out(F.col("doc_id"), HELD_OUT_FOLDS))
