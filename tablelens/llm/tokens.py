"""Token counts by a compiled transducer (4).

Each text is cut into chunks of about ``CHUNK`` characters and all chunks of a batch
are read side by side, one character a step. A chunk that opens at a word border (a
space mark after another character, which no piece spans) has one map for all entry
states. Elsewhere the entry state isn't known yet, so the map is first evaluated at
the state that the ``LOOKBACK`` characters before it lead to. The maps entry ->
(exit, tokens) are then composed in order: where a chunk's entry isn't its
predecessor's exit, the map is evaluated again at that exit. When all join, a prefix
scan by doubling adds up the counts. So the counts are exact whatever the guess; the
guess only decides how often a chunk is read.

Nothing is shuffled: a text never leaves its row. Texts above ``BLOCK``
characters pass through in blocks that hand on the state, so memory is bounded by
the block and by the automaton's own bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import kept, register, table
from tablelens.llm.pieces import SPACE, PieceTables, Transducer, code_points, read_model, utf8_extra

CHUNK, LOOKBACK, BLOCK = 64, 32, 2_000_000
TOKEN_LIMIT = 4096


def _run(tr: Transducer, chars: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray,
         path: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Read lanes side by side from their entry states; exit states and token counts. ``path`` gets the state after each character."""
    order = np.argsort(-size, kind="stable")
    start, size, state = start[order], size[order], entry[order].copy()
    count = np.zeros(len(order), np.int64)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))   # lanes longer than k
        at = start[:n] + k
        state[:n], emit = tr.step(state[:n], chars[at].astype(np.int64))
        count[:n] += emit
        if path is not None:
            path[at] = state[:n]
    out_s, out_c = np.empty_like(state), np.empty_like(count)
    out_s[order], out_c[order] = state, count
    return out_s, out_c


def _scan(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Inclusive prefix sums within runs that begin at ``first``, by doubling."""
    total, head, step = count.copy(), first.copy(), 1
    while not head.all():
        before, closed = total.copy(), head.copy()
        open_ = np.flatnonzero(~closed[step:]) + step
        total[open_] += before[open_ - step]
        head[open_] |= closed[open_ - step]
        head[:step] = True
        step *= 2
    return total


def read_texts(tr: Transducer, chars: np.ndarray, offset: np.ndarray, entry: np.ndarray,
               keep_path: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Exit state and tokens of each text (positions offset[i]:offset[i+1], entered at entry[i])."""
    n_texts = len(offset) - 1
    sizes = np.diff(offset)
    n_chunks = (sizes + CHUNK - 1) // CHUNK
    text = np.repeat(np.arange(n_texts), n_chunks)
    if not len(text):
        return entry.astype(np.int64), np.zeros(n_texts, np.int64), np.zeros(0, np.int32) if keep_path else None
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    start = offset[text] + nth * CHUNK
    stop = offset[text + 1]
    first = nth == 0
    free = np.zeros(len(text), bool)                     # opens at a word border: entered as at a text's start
    mark = chars == tr.t.space
    border = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1 if tr.t.spaced else np.zeros(0, np.int64)
    if len(border):
        at = np.searchsorted(border, start)
        near = border[np.minimum(at, len(border) - 1)]
        free = ~first & (at < len(border)) & (near < np.minimum(start + CHUNK, stop))
        start = np.where(free, near, start)
    size = np.append(start[1:], 0) - start
    closing = np.append(first[1:], True)
    size[closing] = (stop - start)[closing]
    path = np.zeros(len(chars), np.int32) if keep_path else None
    enter = np.where(first, entry[text], 0).astype(np.int64)
    later = np.flatnonzero(~first & ~free)
    if len(later):
        back = np.full(len(later), LOOKBACK, np.int64)
        enter[later], _ = _run(tr, chars, start[later] - LOOKBACK, back, np.zeros(len(later), np.int64), None)
    leave, count = _run(tr, chars, start, size, enter, path)
    while len(later):
        wrong = later[leave[later - 1] != enter[later]]
        if not len(wrong):
            break
        enter[wrong] = leave[wrong - 1]
        leave[wrong], count[wrong] = _run(tr, chars, start[wrong], size[wrong], enter[wrong], path)
    out_state, out_count = entry.astype(np.int64).copy(), np.zeros(n_texts, np.int64)
    ends = np.cumsum(n_chunks)[n_chunks > 0] - 1
    if len(ends):
        out_state[n_chunks > 0] = leave[ends]
        out_count[n_chunks > 0] = _scan(first, count)[ends]
    return out_state, out_count, path


def count_tokens(tr: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)

    def add(which: list[int], parts: list[str], states: np.ndarray, marked: bool) -> np.ndarray:
        if marked:
            points, offset = code_points(parts)
        else:
            joined = "".join(parts).replace(" ", SPACE)
            points, offset = np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.array([0, len(joined)], np.int64)
        chars = tr.t.char_of[points]
        state, count, _ = read_texts(tr, chars, offset, states)
        extra = np.concatenate([[0], np.cumsum(np.where(chars == 0, utf8_extra(points), 0))])
        out[which] += count + extra[offset[1:]] - extra[offset[:-1]]
        return state

    group, held = [], 0
    for i, t in enumerate([*texts, None]):
        if t is None or held + len(t) > BLOCK:
            if group:
                add(group, [texts[g] for g in group], np.zeros(len(group), np.int64), True)
            group, held = [], 0
        if t is None:
            break
        if len(t) <= BLOCK:
            group.append(i)
            held += len(t)
            continue
        state = add([i], [t[:BLOCK]], np.zeros(1, np.int64), True)
        for lo in range(BLOCK, len(t), BLOCK):
            state = add([i], [t[lo:lo + BLOCK]], state, False)
    tr.trim()
    return out


def machine(tables: PieceTables) -> Transducer:
    """This process's automaton for the tables: later tasks of the same worker start with what earlier ones built."""
    return kept(("pieces", tables.key), lambda: Transducer(tables))


def compile_tables(model_path: str) -> PieceTables:
    """The transducer's fixed tables, compiled on the driver (a few MB, bounded by the vocabulary)."""
    with open(model_path, "rb") as f:
        return PieceTables(read_model(f.read()))


def token_count(spark: SparkSession, text: Column, model_path: str) -> Column:
    """Number of tokens of a text column under a merge-type piece model. Null and empty texts have 0."""
    tables = spark.sparkContext.broadcast(compile_tables(model_path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tr = machine(tables.value)
        for s in batches:
            yield pd.Series(count_tokens(tr, s.fillna("").tolist()), dtype="int64")

    return counted(text)


def document_tokens(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``, other columns ignored.

    Null text counts as empty (0 bytes, 0 tokens, not over). Null and repeated ids
    stay as they are; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = token_count(spark, F.col("text"), model_path)
    return (docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        n.alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return document_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
