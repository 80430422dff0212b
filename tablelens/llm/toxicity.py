"""Toxicity by non-negative positive-unlabelled learning (3).

Confirmed toxic texts are the positives; unlabelled texts, which hold toxic ones too, are
everything else. The classifier is linear over words and word beginnings and how
often they occur, trained in numpy on the risk ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` with the logistic
loss. Where the bracket of a minibatch falls below zero by more than ``SLACK`` of the prior, its
gradient is turned round, so the unlabelled part can't be fitted past the class prior.

A feature is a candidate if the class prior makes it informative: with the rates a among
positives and b among unlabelled texts, ``prior * a / b`` estimates the share of toxic
texts among those that hold it, and a has to exceed b by ``MIN_Z`` standard errors.
Candidates that together cover the positives take part.

Training reads a bounded sample: the ``max_positive`` positives and ``max_unlabelled``
other texts of the training rows with the smallest md5 of the id. Scoring reads every whole
text in its own row: no shuffle, the weights (at most MAX_FEATURES) are broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import fresh, held_out, register, release, table

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4000, 8000, 2000
PREFIXES, DENSE = (4, 5, 6, 7, 8), 100
MIN_Z, MIN_SHARE = 4.0, 0.5
COVER, MIN_GAIN = 3, 0.002
EPOCHS, RATE, DECAY, BATCHES = 150, 0.1, 0.0, 4
#: a minibatch's unlabelled risk may fall below zero by this share of the prior (sampling noise) before it is turned round
SLACK = 1.0
HELD_OUT_FOLDS = 5
WORD_CACHE = 150_000
#: unlabelled texts whose features are counted together
SLAB = 500


def word_parts(word: str) -> list[int]:
    """Numbers of the word (letters and digits, lower case) and of its beginnings."""
    s = "".join(c for c in word.lower() if c.isalnum())
    if not s:
        return []
    return [crc32(b"w" + s.encode()), *(crc32(b"p" + s[:k].encode()) for k in PREFIXES if len(s) >= k)]


def levels(counts: dict[int, int], n_words: int) -> list[int]:
    """Features of the counted parts: present; twice; four times; at least one word in DENSE."""
    out = []
    for part, n in counts.items():
        out.append(part * 4)
        if n >= 2:
            out.append(part * 4 + 1)
            if n >= 4:
                out.append(part * 4 + 2)
            if n * DENSE >= n_words:
                out.append(part * 4 + 3)
    return out


def features(text: str) -> np.ndarray:
    """Features of a whole text."""
    words, counts = Counter(text.split()), Counter()
    for w, n in words.items():
        for part in word_parts(w):
            counts[part] += n
    return np.array(sorted(levels(counts, words.total())), np.int64)


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for x in batches:
        yield pd.DataFrame({"p": x["p"], "f": [features(t).tobytes() for t in x["text"].fillna("")]})


class Classifier:
    """Linear scores over features: ``names`` sorted, ``weight`` alike, ``bias``."""

    def __init__(self, names: np.ndarray, weight: np.ndarray, bias: float):
        self.names, self.weight, self.bias = names, weight, bias
        self._of = {int(n): float(w) for n, w in zip(names, weight)}
        self._parts = {n >> 2 for n in self._of}
        self._words: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        words, seen = Counter(text.split()), self._words
        counts: dict[int, int] = {}
        for w, n in words.items():
            hit = seen.get(w)
            if hit is None:
                if len(seen) > WORD_CACHE:
                    seen.clear()
                hit = seen[w] = tuple(p for p in word_parts(w) if p in self._parts)
            for p in hit:
                counts[p] = counts.get(p, 0) + n
        z = self.bias
        if counts:
            z += sum(self._of.get(f, 0.0) for f in sorted(levels(counts, words.total())))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def holding(names: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """How many of the rows hold each of the sorted ``names``, SLAB rows at a time: no copy of all rows."""
    out = np.zeros(len(names), np.int64)
    for lo in range(0, len(rows) if len(names) else 0, SLAB):
        part = np.sort(np.concatenate(rows[lo:lo + SLAB]))
        at = np.minimum(np.searchsorted(names, part), len(names) - 1)
        out += np.bincount(at[names[at] == part], minlength=len(names))
    return out


def informative(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """The features that take part, sorted, and the class prior seen in the unlabelled texts.

    Candidates are taken greedily, each time the one that occurs in most positives that
    hold fewer than COVER chosen ones, so that words shared only by copies of one
    toxic text don't come in beside what is toxic in it. A feature of toxic texts alone is as
    much rarer among the unlabelled as the prior says: the median of b / a over the first
    ones corrects the prior downward.
    """
    names, n_p = np.unique(np.concatenate(positive), return_counts=True)
    n_u = holding(names, unlabelled)
    a, b = n_p / len(positive), n_u / len(unlabelled)
    pool = (n_p + n_u) / (len(positive) + len(unlabelled))
    z = (a - b) / np.sqrt(pool * (1 - pool) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    share = prior * a / np.maximum(b, 0.5 / len(unlabelled))
    wanted = (n_p >= 2) & (z >= MIN_Z) & (share >= MIN_SHARE)
    names, n_u = names[wanted], n_u[wanted]
    docs = [r[np.isin(r, names, assume_unique=True)] for r in positive]
    flat = np.searchsorted(names, np.concatenate(docs))
    owner = np.repeat(np.arange(len(docs)), [len(r) for r in docs])
    order = np.argsort(flat, kind="stable")
    start = np.searchsorted(flat[order], np.arange(len(names) + 1))
    need = np.full(len(docs), COVER)
    gain, chosen = np.bincount(flat, minlength=len(names)), []
    while len(chosen) < MAX_FEATURES and len(names):
        best = int(np.argmax(gain))
        if gain[best] < max(2, MIN_GAIN * len(docs)):
            break
        chosen.append(best)
        gain[best] = -1
        here = owner[order[start[best]:start[best + 1]]]
        need[here] -= 1
        done = here[need[here] == 0]                   # these texts are explained
        gain[:] -= np.where(gain >= 0, np.bincount(flat[np.isin(owner, done)], minlength=len(names)), 0)
    # the strongest first: those of toxic texts alone
    pick = names[chosen]
    if len(pick):
        u = n_u[chosen[:16]] / len(unlabelled)
        p = np.array([sum(f in set(r.tolist()) for r in docs) for f in pick[:16]]) / len(positive)
        prior = float(np.clip(np.median(u / p), prior / 4, prior))
    return np.sort(pick), prior


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 7) -> Classifier:
    """Non-negative risk minimisation with Adam over minibatches that hold a share of each part."""
    if not positive or not unlabelled:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    names, prior = informative([p for p in positive if len(p)] or [np.zeros(0, np.int64)],
                        [u for u in unlabelled if len(u)] or [np.zeros(1, np.int64)], prior)

    def numbered(rows: list[np.ndarray]) -> list[np.ndarray]:
        if not len(names):
            return [np.zeros(0, np.int64) for _ in rows]
        at = [np.minimum(np.searchsorted(names, r), len(names) - 1) for r in rows]
        return [i[names[i] == r] for i, r in zip(at, rows)]

    positive, unlabelled = numbered(positive), numbered(unlabelled)
    dim = len(names)
    w, m, v = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    w[-1] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)

    def grad(rows: list[np.ndarray], dz: np.ndarray) -> np.ndarray:
        out = np.bincount(np.concatenate(rows), np.repeat(dz, [len(r) for r in rows]), dim + 1)
        out[-1] += dz.sum()
        return out

    def outputs(rows: list[np.ndarray]) -> np.ndarray:
        return np.array([w[r].sum() for r in rows]) + w[-1]

    t = 0
    for _ in range(EPOCHS):
        ps = np.array_split(rng.permutation(len(positive)), min(BATCHES, len(positive)))
        us = np.array_split(rng.permutation(len(unlabelled)), min(BATCHES, len(unlabelled)))
        for k in range(max(len(ps), len(us))):
            p = [positive[i] for i in ps[k % len(ps)]]
            u = [unlabelled[i] for i in us[k % len(us)]]
            zp, zu = outputs(p), outputs(u)
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_rest = grad(u, su / len(u)) - prior * grad(p, sp / len(p))
            g = prior * grad(p, (sp - 1) / len(p)) + g_rest if rest >= -SLACK * prior else -g_rest
            g[:-1] += DECAY * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Classifier(names, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = HELD_OUT_FOLDS, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """A classifier from the training rows (crc32 of the id modulo ``folds`` not 0).

    The prior is the share of toxic rows among the labelled training rows. Ids labelled
    both ways count as toxic. Without positives every text scores the (smallest) prior.
    """
    lab = (labels.select(F.col(id_col).alias("lid"), F.col(label_col).alias("y")).where(~held_out(F.col("lid"), folds))
           .where("lid IS NOT NULL AND y IS NOT NULL").groupBy("lid").agg(F.max("y").alias("y")))
    share = lab.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0
    order = F.md5(F.col("id").cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & ~held_out(F.col("id"), folds))
    # choose ids first: only the chosen texts move
    ids = rows.select("id").distinct()
    pos = ids.join(lab.where("y = 1"), F.col("id") == F.col("lid"), "left_semi").orderBy(order).limit(max_positive)
    other = ids.orderBy(F.md5(F.concat(F.lit("u"), F.col("id").cast("string")).cast("binary"))).limit(max_unlabelled)
    want = pos.select("id", F.lit(1).alias("p")).unionByName(other.select("id", F.lit(0).alias("p")))

    # at most max_positive + max_unlabelled rows of distinct feature numbers reach the driver, as bytes: no Python number each
    chosen = rows.join(F.broadcast(want), "id").select("p", "text").mapInPandas(_feature_rows, "p int, f binary")
    parts: tuple[list, list] = ([], [])
    for r in chosen.toLocalIterator():
        parts[0 if r["p"] == 1 else 1].append(np.frombuffer(r["f"], np.int64))
    return fit(parts[0], parts[1], min(max(share, 1e-4), 0.5))


def scored(docs: DataFrame, model: Classifier, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` with the score (0 to 1) of the whole text; its column's name."""
    weights = docs.sparkSession.sparkContext.broadcast((model.names, model.weight, model.bias))
    name, = fresh(docs.columns, "score")

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        model = Classifier(*weights.value)
        for s in batches:
            yield pd.Series([model.score(t) for t in s.fillna("")], dtype="float64")

    return docs.withColumn(name, of(F.col(text_col))), name


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out, score = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), HELD_OUT_FOLDS).alias("held_out"), F.col(score).alias("score"),
                      (F.col(score) >= 0.5).cast("int").alias("predicted"))
