"""Benchmark decontamination by a distributed positional inverted index (13).

``build`` cuts the training texts into segments of bounded size and stores, for every segment
and term, the term's positions in it: a posting list. Documents of a segment lie ``REACH`` positions
apart, so no phrase or span crosses them; a document longer than a segment continues in the next one,
which repeats nothing but follows ``REACH`` words that the earlier one has too, and each part answers
for the starts it owns.

``occurrences`` asks for windows of test words, in blocks that are bounded and therefore fit in
every task. (1) Corpus frequencies of the block's terms: a window with a term that the corpus lacks
can't occur. (2) The lists of each window's two rarest terms are intersected segment by segment:
places of the rarest that have the second within a span. (3) Only for segments with such places the
other terms' lists are read. An exact phrase is what is left of the starts (place of the rarest
less its offset) after intersecting them with every list less its offset, rarest first. A proximity
match is a span of at most window + ``slack`` words that holds all words of the window as
often as the window does, in any order.

Defined results: null, empty and wordless texts have no words and no hits; null or wordless items
have no windows; a null item id is named 'null'. Every document row has its own result, also where
rows repeat; items that share an id count once. Columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import broadcast_if_small, register, table, written
from tablelens.session import checkpoint_dir

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: words of a segment; positions between its documents, longest span that can be asked; windows that are asked together
SEGMENT, REACH, BLOCK = 1 << 20, 32, 100_000
#: keys of needed lists that are broadcast (16 bytes each) after they have been counted; more are joined by a shuffle
KEYS = 1_000_000


# ---- words

def words_of(texts: pa.Array) -> pa.Array:
    """The words of each text (A-Z lower-cased); null and wordless texts have none."""
    cut = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NOT_A_WORD)
    flat, ends = cut.flatten(), cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), flat.filter(full))


# ---- the index

def _slices(batch: pa.RecordBatch, most: int):
    """Runs of rows whose texts have at most ``most`` bytes together, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        end = max(int(np.searchsorted(size, base + most, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The stored index. Posting rows: segment, term, n, positions. Part rows (null term): segment, base, owned, doc, id, first, words.

    ``base`` is the position of a part's first word, ``owned`` how many starts it answers for, ``first``
    the place of that word in the document ``doc``, ``words`` the document's words (on its first part, else null).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"segment long, term string, n int, positions array<int>, base int, owned int, doc long, id {id_type}, first long, words long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, docs_seen = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 32
        names = None
        for batch in batches:
            blank = {"term": pa.string(), "n": pa.int32(), "positions": pa.list_(pa.int32()), "base": pa.int32(), "owned": pa.int32(),
                     "doc": pa.int64(), "id": batch.column(0).type, "first": pa.int64(), "words": pa.int64()}
            names = ["segment", *blank]

            def row_batch(number, **cols):
                n = len(next(iter(cols.values())))
                arrays = [pa.array(np.full(n, number))] + [cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in blank.items()]
                return pa.RecordBatch.from_arrays(arrays, names)

            for some in _slices(batch, 6 * segment):
                lists = words_of(some.column(1))
                flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
                sizes = np.diff(ends)
                # parts (row, first word, words with the overlap, owned starts); only a text beyond a segment has several
                parts = [(i, f, min(segment + REACH, n - f), min(segment, n - f)) for i, n in enumerate(sizes) for f in range(0, max(n, 1), segment)]
                groups, room = [[]], segment
                for p in parts:
                    if groups[-1] and p[2] > room:
                        groups.append([])
                        room = segment
                    groups[-1].append(p)
                    room -= p[2]
                for group in groups:
                    row, first, long, owned = (np.array(c, np.int64) for c in zip(*group))
                    base = np.concatenate([[0], np.cumsum(long + REACH)[:-1]])
                    place = np.arange(long.sum()) + np.repeat(base - np.concatenate([[0], np.cumsum(long)[:-1]]), long)
                    taken = pa.concat_arrays([flat.slice(ends[i] + f, k) for i, f, k in zip(row, first, long)]) if len(group) > 1 or long[0] < len(flat) else flat
                    coded = taken.dictionary_encode()
                    code = coded.indices.to_numpy()
                    order, counts = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(coded.dictionary))
                    upto = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    if len(counts):
                        yield row_batch(made, term=coded.dictionary, n=pa.array(counts),
                                        positions=pa.ListArray.from_arrays(upto, pa.array(place[order].astype(np.int32))))
                    yield row_batch(made, base=pa.array(base), owned=pa.array(owned), doc=pa.array(docs_seen + row),
                                    id=some.column(0).take(pa.array(row)), first=pa.array(first),
                                    words=pa.array([int(sizes[i]) if f == 0 else None for i, f in zip(row, first)], pa.int64()))
                    made += 1
                docs_seen += some.num_rows

    return written(docs.select(id_col, text_col).mapInArrow(rows, schema))


# ---- asking

class _Asked:
    """A block of windows as numbers: terms, rarest first, with their offsets; windows with a term the corpus lacks are left out."""

    def __init__(self, block: pa.Table, frequency: dict[str, int], slack: int):
        self.number, self.plan, self.span, self.size = [], [], [], []
        for number, terms in zip(block["window"].to_pylist(), block["terms"].to_pylist()):
            if all(t in frequency for t in terms):
                offsets = {}
                for o, t in enumerate(terms):
                    offsets.setdefault(t, []).append(o)
                self.number.append(number)
                self.plan.append(sorted(offsets.items(), key=lambda e: (frequency[e[0]], e[0])))
                self.span.append(len(terms) + slack)
                self.size.append(len(terms))
        self.at = {n: i for i, n in enumerate(self.number)}

    def rarest(self) -> list[str]:
        return sorted({t for p in self.plan for t, _ in p[:2]})


def _near(a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """The entries of ``a`` with an entry of ``b`` in a common span (both sorted)."""
    return a[np.searchsorted(b, a + span, "left") > np.searchsorted(b, a - span, "right")]


def _places(asked: _Asked):
    """(segment, window, at): places of each window's rarest term that have its second rarest near."""
    first = [p[0][0] for p in asked.plan]
    second = [p[1][0] if len(p) > 1 else None for p in asked.plan]

    def intersect(group: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(group["term"], group["positions"]))
        out = []
        for w, (a, b) in enumerate(zip(first, second)):
            if a in held and (b is None or b in held):
                found = held[a] if b is None else _near(held[a], held[b], asked.span[w])
                if len(found):
                    out.append((group["segment"].iloc[0], asked.number[w], found))
        return pd.DataFrame(out, columns=["segment", "window", "at"])

    return intersect


def phrase_starts(plan, at: np.ndarray, held: dict) -> np.ndarray:
    """Starts of exact occurrences: places of the rarest term less its offset, intersected with every list less its offset."""
    starts = at - plan[0][1][0]
    for term, offsets in plan:
        for o in offsets:
            if not len(starts):
                return starts
            list_, want = held[term], starts + o
            starts = starts[list_[np.minimum(np.searchsorted(list_, want), len(list_) - 1)] == want]
    return starts


def span_starts(plan, at: np.ndarray, held: dict, span: int) -> np.ndarray:
    """Starts of spans that hold every term as often as the window does, the rarest at one of the places ``at``."""
    starts = np.unique((at[:, None] - np.arange(span)).ravel())
    for term, offsets in plan:
        if not len(starts):
            break
        list_ = held[term]
        starts = starts[np.searchsorted(list_, starts + span) - np.searchsorted(list_, starts) >= len(offsets)]
    return starts


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover the given half-open ones."""
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


_HITS = "doc long, spans array<array<long>>, windows array<long>, near array<long>"


def _verify(asked: _Asked):
    """Rows of _HITS for a segment's candidate places, given its lists and parts."""
    def check(found: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: [] for c in _HITS.split(", ")}, dtype=object)
        if not len(found):
            return empty
        posted, parts = lists[lists["term"].notna()], lists[lists["term"].isna()].sort_values("base")
        held = dict(zip(posted["term"], posted["positions"]))
        base, owned = parts["base"].to_numpy(np.int64), parts["owned"].to_numpy(np.int64)

        def owner(places):
            """(part, kept): which part each place lies in, and whether that part answers for it."""
            part = np.searchsorted(base, places, "right") - 1
            return part, places < base[part] + owned[part]

        exact, near = [], []
        for number, at in zip(found["window"], found["at"]):
            w = asked.at[number]
            plan = asked.plan[w]
            if any(t not in held for t, _ in plan):
                continue
            at = at.astype(np.int64)
            for starts, out in ((phrase_starts(plan, at, held), exact), (span_starts(plan, at, held, asked.span[w]), near)):
                starts = starts[starts >= 0]
                part, mine = owner(starts)
                if mine.any():
                    out.append((part[mine], np.full(mine.sum(), number), starts[mine], starts[mine] + asked.size[w]))
        if not near:
            return empty
        part, number, start, end = (np.concatenate(c) for c in zip(*exact)) if exact else [np.zeros(0, np.int64)] * 4
        near_part, near_number = (np.concatenate(c) for c in list(zip(*near))[:2])
        doc, first = parts["doc"].to_numpy(np.int64), parts["first"].to_numpy(np.int64)
        rows = []
        for p in np.unique(near_part):
            mine = part == p
            move = first[p] - base[p]
            spans = [[int(s + move), int(e + move)] for s, e in zip(*_merge(start[mine], end[mine]))] if mine.any() else []
            rows.append((doc[p], spans, np.unique(number[mine]).tolist(), np.unique(near_number[near_part == p]).tolist()))
        return pd.DataFrame(rows, columns=["doc", "spans", "windows", "near"])

    return check


def occurrences(index: DataFrame, windows: DataFrame, slack: int = 2) -> DataFrame:
    """Rows (doc, spans, windows, near) of a stored index: merged half-open word ranges of exact occurrences, the
    windows that occur, and the windows that have a proximity match (every exact occurrence is one).

    ``windows`` has window (a number of its own) and terms (array). A document may have several rows, one a part and block.
    """
    spark = index.sparkSession
    postings = index.where(F.col("term").isNotNull())
    parts = index.where(F.col("term").isNull())
    place = os.path.join(checkpoint_dir(spark), f"llm-hits-{uuid.uuid4().hex}")
    spark.createDataFrame([], _HITS).write.parquet(place)
    blocks = max(-(-windows.count() // BLOCK), 1)
    for n in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == n).select("window", "terms").toArrow()
        if not block.num_rows:
            continue
        if max(map(len, block["terms"].to_pylist())) + slack > REACH:
            raise ValueError("a window is longer than the index reaches")

        def asked_terms(terms) -> DataFrame:                # at most the words of a block
            return F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())})))

        vocabulary = sorted({t for terms in block["terms"].to_pylist() for t in terms})
        counted = postings.select("term", "n").join(asked_terms(vocabulary), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()
        asked = _Asked(block, {r["term"]: r["n"] for r in counted}, slack)
        if not asked.number:
            continue
        rare = postings.select("segment", "term", "positions").join(asked_terms(asked.rarest()), "term")
        found = written(rare.groupBy("segment").applyInPandas(_places(asked), "segment long, window long, at array<int>"))
        left = [r["window"] for r in found.select("window").distinct().collect()]
        vocabulary = sorted({t for w in left for t, _ in asked.plan[asked.at[w]]})
        # lists are told by a hash of (segment, term): one too many does no harm, its term isn't looked up
        key = F.xxhash64("segment", "term")
        needed = written(found.join(windows, "window").select("segment", F.explode("terms").alias("term")).select(key.alias("key")).distinct())
        lists = (postings.join(asked_terms(vocabulary), "term").withColumn("key", key)
                 .join(F.broadcast(needed) if needed.count() <= KEYS else needed, "key", "left_semi")
                 .select("segment", "term", "positions", "base", "owned", "doc", "first"))
        own = (parts.join(broadcast_if_small(found.select("segment").distinct()), "segment")
               .select("segment", "term", "positions", "base", "owned", "doc", "first"))
        hits = found.groupBy("segment").cogroup(lists.unionByName(own).groupBy("segment")).applyInPandas(_verify(asked), _HITS)
        hits.write.mode("append").parquet(place)
    return spark.read.schema(_HITS).parquet(place)


def item_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((window, terms), (window, item)): the distinct runs of ``size`` words of the items, shorter items as one run."""
    words = F.arrow_udf(words_of, "array<string>")
    cut = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    runs = written(cut.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("terms")).distinct())
    windows = written(runs.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"))
    return windows, runs.join(windows, "terms").select("window", "item")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slack: int = 2, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, spans (merged hit word ranges), items and near_items (sorted texts of ids), n_hit."""
    index = build(docs, id_col, text_col)
    windows, holders = item_windows(items, size, item_col, item_text)
    hits = occurrences(index, windows, slack)
    spans = hits.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    # spans of different parts and blocks may overlap: keep the covered ones apart
    state = F.struct(F.array().cast("array<array<bigint>>").alias("done"), F.lit(0).cast("bigint").alias("n"))

    def add(acc, span):
        last = F.try_element_at(acc["done"], F.lit(-1))
        joins = F.coalesce(last[1] >= span[0], F.lit(False))
        merged = F.array(last[0], F.greatest(last[1], span[1]))
        done = F.when(joins, F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(merged))).otherwise(
            F.concat(acc["done"], F.array(span)))
        grown = F.when(joins, F.greatest(span[1] - last[1], F.lit(0))).otherwise(span[1] - span[0])
        return F.struct(done.alias("done"), (acc["n"] + grown).cast("bigint").alias("n"))

    covered = spans.select("doc", F.aggregate("s", state, add).alias("c")).select("doc", F.col("c.done").alias("spans"), F.col("c.n").alias("n_hit"))

    def named(col: str, out: str) -> DataFrame:
        pairs = hits.select("doc", F.explode(col).alias("window")).distinct().join(broadcast_if_small(holders), "window").select("doc", "item").distinct()
        return pairs.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias(out))

    rows = index.where("term IS NULL AND words IS NOT NULL").select("doc", F.col("id").alias(id_col), F.col("words").alias("n_words"))
    none = F.array().cast("array<string>")
    return (rows.join(covered, "doc", "left").join(named("windows", "items"), "doc", "left").join(named("near", "near_items"), "doc", "left")
            .select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"),
                    F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
r AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM r),
grams AS (SELECT k, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
    FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes)),
hit AS (SELECT DISTINCT k, item, s, n FROM grams JOIN r USING (n, g)),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k),
post AS (SELECT k, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (SELECT row_number() OVER () AS wi, g, n FROM (SELECT DISTINCT g, n FROM r)),
wt AS (SELECT wi, n, t, count(*) AS m FROM (SELECT wi, n, unnest(string_split(g, ' ')) AS t FROM win) GROUP BY ALL),
need AS (SELECT wi, count(*) AS c FROM wt GROUP BY wi),
both_ AS (SELECT k, wi FROM (SELECT k, t FROM post GROUP BY ALL) JOIN wt USING (t) JOIN need USING (wi) GROUP BY k, wi, c HAVING count(*) = c),
occ AS (SELECT k, wi, n, t, m, p FROM both_ JOIN wt USING (wi) JOIN post USING (k, t)),
span AS (SELECT a.k, a.wi, a.p, b.t FROM (SELECT DISTINCT k, wi, p FROM occ) a JOIN occ b ON a.k = b.k AND a.wi = b.wi
    AND b.p BETWEEN a.p AND a.p + b.n + 1 GROUP BY a.k, a.wi, a.p, b.t, b.m HAVING count(*) >= b.m),
near AS (SELECT DISTINCT k, wi FROM (SELECT k, wi, p, count(*) AS c FROM span GROUP BY ALL) JOIN need USING (wi, c)),
near_items AS (SELECT k, count(DISTINCT item) AS n_near_items FROM near JOIN win USING (wi) JOIN r USING (g, n) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN covered USING (k) LEFT JOIN named USING (k) LEFT JOIN near_items USING (k)
"""


@register("op13_benchmark_decontamination", ORACLE_SQL)
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near_items"))
