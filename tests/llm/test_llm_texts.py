"""Text operators against the tokenizer library, brute force and SQL on small fixtures."""

import gc
import math
import random
import re
import tracemalloc
import weakref
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tablelens.llm import common, ctw, encode, mixing, simhash, substring, tokens, toxicity
from tablelens.llm.common import components, held_out
from tablelens.llm.pieces import Transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "  a  b ", "▁x", "x\x00y", "日本語 テスト 😀😀é", "a" * 700, " " * 300, "ab" * 400, "#$%" * 200, "<s> </s> <0x41>",
       "tab\tnew\nline", "ﬁ Å é", "loser " * 3]


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(2)) + str(r.randrange(vocab)) for _ in range(n))


def frame(spark, texts, ids=None, source=None):
    ids = list(range(1, len(texts) + 1)) if ids is None else ids
    source = ["s"] * len(texts) if source is None else source
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, source)], SCHEMA)


@pytest.fixture(scope="module")
def tables():
    return tokens.compile_tables(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# ---- 4, 6: transducer and streaming encoder

@pytest.mark.parametrize("block", [17, 100, 2_000_000])
def test_counts_and_ids_equal_the_library(tables, library, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    texts = ODD + [words(60, 1), words(2000, 2)]
    want = library.encode(texts)
    machine = Transducer(tables)
    assert tokens.count_tokens(machine, texts).tolist() == [len(w) for w in want]
    got = encode.Encoder(machine).encode(texts)
    assert [g.tolist() for g in got] == want
    of = encode.piece_bytes(MODEL)
    assert [encode.decode_ids(w, of) for w in want] == [library.decode(w) for w in want]


def test_stream_commits_before_the_text_ends(tables, library):
    text = words(300, 3)
    parts = list(encode.Encoder(Transducer(tables)).stream(text[k:k + 50] for k in range(0, len(text), 50)))
    assert len(parts) > 5 and np.concatenate(parts).tolist() == library.encode(text)


def test_automaton_is_rebuilt_past_its_bound(tables, library):
    machine = Transducer(tables, max_states=50)
    for t in (words(100, 4), words(100, 5)):
        assert tokens.count_tokens(machine, [t])[0] == len(library.encode(t))
        assert machine.n_states <= 50 or machine.n_states > 1


def test_token_frames(spark, library):
    docs = frame(spark, ["a b", None, words(5000, 6), "a b"], [1, 2, None, 1]).withColumn("n_tokens", F.lit("clash"))
    rows = {(r.doc_id, r.n_bytes): r for r in tokens.document_tokens(docs, MODEL).collect()}
    assert rows[(2, 0)].n_tokens == 0 and not rows[(2, 0)].over_limit
    long = next(r for r in rows.values() if r.doc_id is None)
    assert long.n_tokens == len(library.encode(words(5000, 6))) and long.over_limit
    assert tokens.document_tokens(docs.limit(0), MODEL).count() == 0


def test_encode_frames(spark, library):
    docs = frame(spark, ["a b", None, "x\ty 日本", "a b"], [1, 2, None, 1]).withColumn("piece_ids", F.lit("clash"))
    out = encode.encode_documents(docs, MODEL)
    got = sorted((r.doc_id or 0, r.n_pieces, list(r.piece_ids)) for r in out.collect())
    a, b = library.encode("a b"), library.encode("x\ty 日本")
    assert got == sorted([(1, len(a), a), (2, 0, []), (0, len(b), b), (1, len(a), a)])
    trips = encode.round_trips(docs, MODEL).collect()
    assert all(r.round_trip for r in trips) and {r.doc_id for r in trips} == {1, 2, None}
    assert encode.round_trips(docs.limit(0), MODEL).count() == 0
    back = out.select(encode.decoded(spark, F.col("piece_ids"), MODEL).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(["a b", "", "x\ty 日本", "a b"])


# ---- 8: SimHash

def plain_fingerprint(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("cell", [3, 4096])
def test_fingerprint_links_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(40)]
    vals = {v ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 6))) for v in base for _ in range(6)} | {0, 1, 2**64 - 1}
    vals = sorted(vals)
    want = roots(len(vals), [(i, j) for i in range(len(vals)) for j in range(i) if (vals[i] ^ vals[j]).bit_count() <= 3])
    signed = [v - 2**64 if v >= 2**63 else v for v in vals]
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert all((vals[at[e.a]] ^ vals[at[e.b]]) is not None for e in edges)
    assert roots(len(vals), [(at[e.a], at[e.b]) for e in edges]) == want


def test_near_duplicates_frame(spark):
    t = words(200, 9)
    texts = [t, t.upper().replace("\n", " "), t.replace(" ", "\t "), None, "", " \n", "One two", "one TWO", words(200, 10), t, t]
    docs = frame(spark, texts, [5, 4, 9, 7, 3, 8, 20, 21, 30, 5, None]).withColumn("kept", F.lit("x")).withColumn("row", F.lit(1))
    out, (fp, comp, kept) = simhash.near_duplicates(docs)
    rows = out.collect()
    assert len(rows) == len(texts) and out.columns[:7] == docs.columns
    for r in rows:
        assert r[fp] % 2**64 == plain_fingerprint(r["text"], 3)
    of = {(r["doc_id"], r["text"]): (r[comp], r[kept]) for r in rows}
    assert of[(4, t.upper())] == (4, True) and of[(9, t.replace(" ", "\t "))] == (4, False) and of[(None, t)][0] == 4
    assert of[(3, "")] == (3, True) and of[(7, None)] == (3, False) and of[(20, "One two")] == (20, True)
    assert sum(r[kept] for r in rows) == 4
    assert simhash.near_duplicates(docs.limit(0))[0].count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {7} and 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2: mixing

def mixing_fixture(spark):
    r = random.Random(12)
    texts = [words(r.randrange(0, 60), 100 + i) for i in range(300)] + [None, "", "dup dup", "dup dup"]
    source = [r.choice(["b", "a", None, "é", "B", "tiny"] + ["hot"] * 6) for _ in range(303)] + ["b"]
    return frame(spark, texts, [*range(302), 302, 302], source)


def test_mixing_equals_its_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs = mixing_fixture(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200, 3)] + [(0, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out, (size, ssize, target, copies, taken) = mixing.mix(docs, labels.select("doc_id", "quality"), keep=["doc_id"])
    got = sorted((r["doc_id"], r[size], r[ssize], round(r[target], 6), r[taken]) for r in out.collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    want = sorted((int(a), b, c, round(d, 6), e) for a, b, c, d, e in con.execute(
        "SELECT doc_id, size, source_size, target, taken FROM (" + mixing.ORACLE_SQL + ")").fetchall())
    assert got == want
    by = {}
    for (_, n, s, t, k) in got:
        by.setdefault((s, t), []).append((n, k))
    total = sum(n for _, n, *_ in got)
    assert abs(sum(t for _, t in by) - total) < 1e-6 * total
    for (s, t), rows in by.items():
        assert t <= 3 * s + 1e-9 and abs(sum(k for _, k in rows) - t) <= max(n for n, _ in rows)
        assert all(k <= 3 * n for n, k in rows)


def test_mixing_edges(spark):
    docs = frame(spark, ["a b", None], source=[None, None]).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1))
    out, names = mixing.mix(docs)
    assert out.columns == docs.columns + names and not set(names) & set(docs.columns)
    assert sorted((r["doc_id"], r[names[0]], r[names[4]]) for r in out.collect()) == [(1, 2, 2), (2, 0, 0)]
    assert mixing.mix(docs.limit(0))[0].count() == 0
    assert mixing.mix(frame(spark, [None, ""]))[0].count() == 2


# ---- 3: toxicity

def toxic_fixture(n=900):
    r = random.Random(3)
    texts, y = [], []
    for i in range(n):
        ws = words(80, 5000 + i, 3000).split()
        bad = i % 8 == 0
        if bad:
            for _ in range(4):
                ws.insert(r.randrange(80), r.choice(["vileword", "zorch" + r.choice("abcdefg"), "Grimsel!"]))
        texts.append(" ".join(ws))
        y.append(int(bad))
    return texts, y


def test_toxicity_held_out(spark):
    texts, y = toxic_fixture()
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i + 1, 0, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out, score = toxicity.scored(docs.withColumn("score", F.lit("clash")), model)
    held = [r for r in out.withColumn("h", held_out(F.col("doc_id"), 5)).collect() if r["h"]]
    assert {r["doc_id"] for r in held} == {i + 1 for i in range(len(texts)) if zlib.crc32(str(i + 1).encode()) % 5 == 0}
    right = [(r[score] >= 0.5) == (y[r["doc_id"] - 1] == 1) for r in held]
    assert sum(right) / len(right) > 0.95
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id"), 5), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert np.array_equal(model.names, again.names) and np.allclose(model.weight, again.weight)


def test_training_texts_come_as_bytes(spark, monkeypatch):
    docs = [(i, words(300, 8000 + i, 10**6)) for i in range(600)]
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda *parts: seen.extend(parts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    tracemalloc.start()
    toxicity.train(frame, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [toxicity.features(t) for i, t in docs if zlib.crc32(str(i).encode()) % 5]
    assert sorted(f.tolist() for f in seen[1]) == sorted(f.tolist() for f in want) and 0 < len(seen[0]) < len(want)
    held = sum(len(f) for part in seen[:2] for f in part)
    assert peak < 24 * held                                # 8 bytes a feature, not a Python number each


def test_toxicity_edges(spark):
    docs = frame(spark, ["", None, "x " * 30_000, "x"], [1, None, 3, 3])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    rows = toxicity.scored(docs, model)[0].collect()
    assert len(rows) == 4 and all(0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), none))[0].count() == 0
    odd = spark.createDataFrame([(None, None, None), (3, None, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, odd))[0].count() == 4


# ---- 9: context-tree weighting

def plain_ctw(train, text, depth):
    """Mixture of all depths by the definition, node by node."""
    nodes = {}

    def decisions(stream):
        raw = b"\n" * depth + stream
        for i in range(depth, len(raw)):
            prefix = 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                yield raw[i - depth:i], prefix, bit
                prefix = prefix << 1 | bit

    def stream(t):
        return b" ".join((t or "").encode().lower().split()) + b"\n"

    for t in train:
        for ctx, prefix, bit in decisions(stream(t)):
            for d in range(depth + 1):
                nodes.setdefault((ctx[depth - d:], prefix), [0, 0])[bit] += 1
    kt = {k: float(ctw.log_kt(np.array([a * 1.0]), np.array([b * 1.0]))[0]) for k, (a, b) in nodes.items()}
    mix = {}
    for d in range(depth, -1, -1):
        below = Counter()
        for (c, p), m in mix.items():
            if len(c) == d + 1:
                below[(c[1:], p)] += m
        for key in [k for k in nodes if len(k[0]) == d]:
            mix[key] = kt[key] if d == depth else math.log(0.5) + np.logaddexp(kt[key], below[key])
    total = 0.0
    for ctx, prefix, bit in decisions(stream(text)):
        one = 0.5
        for d in range(depth, -1, -1):
            key = (ctx[depth - d:], prefix)
            a, b = nodes.get(key, (0, 0))
            own = (b + 0.5) / (a + b + 1)
            stay = 1.0 if d == depth else math.exp(math.log(0.5) + kt.get(key, 0.0) - mix.get(key, 0.0))
            one = own if d == depth else stay * own + (1 - stay) * one
        total += math.log10(one if bit else 1 - one)
    return total


def test_language_model_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 400)
    texts = [words(12, 40 + i, 5) for i in range(30)] + ["", None, "Ünï \t cödé", words(12, 41, 5).upper()]
    docs = frame(spark, texts, [*range(1, 34), None]).withColumn("score", F.lit("clash"))
    rows = {r.doc_id: r for r in ctw.score_texts(docs, held_out(F.col("doc_id"), 10)).collect()}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in rows}
    assert len(rows) == 34 and any(held.values()) and all(rows[i].held_out == h for i, h in held.items())
    by = dict(zip([*range(1, 34), None], texts))
    train = [t for i, t in by.items() if not held[i]]
    count = Counter(w for t in train for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(count.values()), len(count)
    for i in [k for k, h in held.items() if h][:3] + [1, 31, 33]:
        ws = [*(by[i] or "").encode().lower().split(), b"\n"]
        assert rows[i].n_tokens == len(ws) and rows[i].train_tokens == n and rows[i].n_known == sum(count[w] > 0 for w in ws)
        assert rows[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert rows[i].score == pytest.approx(plain_ctw(train, by[i], ctw.DEPTH), rel=1e-9)
    assert ctw.score_texts(docs.limit(0), held_out(F.col("doc_id"), 10)).count() == 0


def test_language_model_slices_and_subtrees(monkeypatch):
    import pandas as pd
    import pyarrow as pa
    texts = [words(15, 70 + i, 4) for i in range(600)] + ["", None, "x" * 500]
    docs = pa.table({"block": np.zeros(603, np.int32), "text": texts, "held": [i % 7 == 0 for i in range(603)]})
    whole = ctw._count_block(docs).to_pydict()
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 300)
    slices = list(ctw._slices(docs))
    assert len(slices) > 100 and [w for part, _ in slices for w in part] == [ctw.stream_words(t) for t in texts]
    assert np.concatenate([h for _, h in slices]).tolist() == docs["held"].to_pylist()
    assert ctw._count_block(docs).to_pydict() == whole and len(set(whole["key"])) == len(whole["key"])
    assert sum(n for k, n in zip(whole["key"], whole["n"]) if k >= 0) == sum(
        len(b" ".join(ctw.stream_words(t))) + 1 for t, h in zip(texts, docs["held"].to_pylist()) if not h)
    monkeypatch.setattr(ctw, "SHARE_GRAMS", 50)
    grams = pd.DataFrame({"key": [k for k in whole["key"] if k >= 0], "n": 1})
    grams = grams.iloc[np.argsort(ctw._context(grams["key"].to_numpy(), ctw.TOP), kind="stable")]
    parts = list(ctw._subtrees(grams.iloc[i:i + 37] for i in range(0, len(grams), 37)))
    near = [set(ctw._context(k, ctw.TOP).tolist()) for k, _ in parts]
    assert len(parts) > 5 and sum(map(len, near)) == len(set.union(*near)) and sum(len(k) for k, _ in parts) == len(grams)


def test_language_model_is_a_distribution():
    total = sum(10 ** plain_ctw(["ab a"], None, 2) for _ in range(1))
    assert 0 < total < 1


# ---- 10: fuzzy passages

def test_passages_found_and_clean_left(spark):
    shared = words(70, 70).split()
    fuzzy = list(shared)
    for i in (10, 30, 31, 52):
        fuzzy[i] = "changed%d" % i
    del fuzzy[40]
    run = "of " * 200
    texts = [words(80, 71) + " " + " ".join(shared) + " " + words(40, 72), words(30, 73) + " " + " ".join(fuzzy) + " " + words(90, 74),
             words(300, 75), words(45, 76), words(45, 76) + " tail", run, run + "end", None, "", "short"]
    docs = frame(spark, texts, [1, 2, 3, 4, 5, 6, 7, None, 9, 10]).withColumn("doc", F.lit("clash")).withColumn("spans", F.lit(0))
    rows = substring.passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in rows}
    assert pairs == {frozenset((1, 2)), frozenset((6, 7))}
    r = next(r for r in rows if {r.doc_id, r.other_id} == {1, 2})
    size = max(r.end - r.start, r.oend - r.ostart)
    assert size >= 66 and r.equal >= 0.8 * size
    left = substring.without_repeats(docs)
    assert left.columns == docs.columns
    got = {x.doc_id: x.text for x in left.collect()}
    cut = r.doc_id
    for i, t in zip([1, 2, 3, 4, 5, 9, 10], [*texts[:5], "", "short"]):
        if i != cut:
            assert got[i] == t
    assert len(got[cut].split()) == len(texts[cut - 1].split()) - (r.end - r.start)
    assert substring.passages(docs.limit(0)).count() == 0


def test_passages_of_a_hot_line(spark):
    line = words(60, 80)
    docs = frame(spark, [words(20, 900 + i) + " " + line for i in range(120)])
    rows = substring.passages(docs).collect()
    assert len(rows) == 119 and len({r.doc_id for r in rows}) == 119 and len({r.other_id for r in rows}) == 1


@pytest.mark.parametrize("reach", [substring.MAX_GAP, 7, 10**6])
def test_chains_equal_brute_force(monkeypatch, reach):
    monkeypatch.setattr(substring, "MAX_GAP", reach)
    r = random.Random(5)
    for _ in range(60):
        seg = np.array([(x, r.randrange(0, 120), r.randrange(5, 12)) for x in sorted(r.sample(range(0, 160), 12))], np.int64)

        def best(j):
            x, y, n = (int(v) for v in seg[j])
            out = float(n)
            for i in range(len(seg)):
                a, b, m = (int(v) for v in seg[i])
                if 0 <= x - a - m <= reach and 0 <= y - b - m <= reach:
                    out = max(out, n + best(i) - substring.GAP_COST * ((x - a - m) + (y - b - m)))
            return out

        def score(chain):
            s = seg[chain]
            gaps = (s[1:, 0] - s[:-1, 0] - s[:-1, 2]) + (s[1:, 1] - s[:-1, 1] - s[:-1, 2])
            assert (s[1:, 0] - s[:-1, 0] - s[:-1, 2]).max(initial=0) <= reach and (s[1:, 1] - s[:-1, 1] - s[:-1, 2]).max(initial=0) <= reach
            return float(s[:, 2].sum() - substring.GAP_COST * gaps.sum())

        found = substring.chains(seg)
        assert score(found[0]) == pytest.approx(max(best(j) for j in range(len(seg))))
        assert sorted(i for c in found for i in c) == list(range(len(seg)))


def test_a_long_block_out_of_reach_does_not_hide_a_near_segment():
    seg = np.array([(0, 0, 200), (250, 250, 8), (262, 262, 8)], np.int64)
    assert sorted(map(tuple, substring.chains(seg))) == [(0,), (1, 2)]


def test_hashes_tell_words_and_runs_apart(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgäß€") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    text = "".join(r.choice(["", " ", "\t"]) + w.upper() + r.choice([" ", "\n", "\x0b\x0c"]) for w in words)
    lower = [w.lower() for w in text.encode().split()]
    whole = substring.word_hashes(text)
    assert len(whole) == len(lower) and len(set(whole.tolist())) == len(set(lower))
    assert len({(h, w) for h, w in zip(whole.tolist(), lower)}) == len(set(lower))
    wide = substring.wide_hashes(whole, 50)
    monkeypatch.setattr(substring, "PIECE", 64)                # words and runs cross the pieces' borders
    assert (substring.word_hashes(text) == whole).all() and (substring.word_hashes("x" * 1000) == substring.word_hashes("X" * 1000)).all()
    assert (substring.wide_hashes(whole, 50) == wide).all() and len(wide) == len(lower) - 49
    assert len(substring.word_hashes(None)) == len(substring.word_hashes(" \n")) == len(substring.wide_hashes(whole[:49], 50)) == 0


@pytest.mark.parametrize("keys", [1_000_000, 0])
def test_exact_runs_equal_brute_force(spark, monkeypatch, keys):
    """Every run of 50 words that a document of a smaller key has too lies in a passage, whether the runs are broadcast or joined."""
    monkeypatch.setattr(substring, "RUN_KEYS", keys)
    r = random.Random(11)
    pool = [[f"w{r.randrange(400)}" for _ in range(r.randrange(50, 75))] for _ in range(4)]
    texts = []
    for _ in range(24):
        words = [f"x{r.randrange(10**6)}" for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            whole = r.choice(pool)
            part = whole if r.random() < 0.5 else whole[:15]
            at = r.randrange(0, len(words) + 1)
            words[at:at] = part
        texts.append(" ".join(words))
    docs = frame(spark, texts, list(range(24)))
    key = {x.doc_id: x.k for x in docs.select("doc_id", substring._keyed(docs, "doc_id", "text").alias("k")).collect()}
    covered = {i: set() for i in key}
    for p in substring.passages(docs).collect():
        covered[p.doc_id] |= set(range(p.start, p.end))
    holders: dict = {}
    for i, t in enumerate(texts):
        w = t.split()
        for at in range(len(w) - 49):
            holders.setdefault(tuple(w[at:at + 50]), []).append((key[i], i, at))
    shared = 0
    for places in holders.values():
        for k, i, at in places:
            if k != min(places)[0]:
                shared += 1
                assert set(range(at, at + 50)) <= covered[i]
    assert shared > 20


def test_pipeline_stages_bound_a_workers_batches_and_leftovers(spark):
    import corpus_pipeline
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = frame(spark, ["x" * 10_000] * 3000).coalesce(1).cache()
    before = spark.conf.get(key) if key in spark.conf.getAll else None

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    try:
        spark.conf.unset(key)
        corpus_pipeline.sentencepiece_encoding(spark, docs, "")
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 30_000_000 and max(got) < 6_000_000      # before: 10,000 rows, whatever their length
        spark.conf.set(key, "123456789")                            # a bound that is set stays
        corpus_pipeline.sentencepiece_encoding(spark, docs, "")
        assert spark.conf.get(key).startswith("123456789")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    held = tokens.machine(tokens.compile_tables(public_tokenizers.path("piece_bpe_32k.model")))
    assert tokens.machine(held.t) is held
    gone = weakref.ref(held)
    del held
    list(substring._seed_rows(iter([])))           # another operator's task in the same worker
    gc.collect()
    assert gone() is None


def test_seeds_of_many_texts_are_those_of_each(monkeypatch):
    r = random.Random(21)
    texts = [" ".join(f"w{r.randrange(k)}" for _ in range(n)) for n in (0, 1, 4, 5, 6, 8, 9, 40, 300) for k in (1, 3, 10**6)]
    texts += [None, " \t", "É Ü " * 9, "x" * (substring.GROUP + 9), "y z " * substring.GROUP] + [words(30, 950 + i) for i in range(200)]
    calls = []
    monkeypatch.setattr(substring, "_range_hashes", lambda *a, f=substring._range_hashes: calls.append(1) or f(*a))
    got = pd.concat(substring._seed_rows(iter([pd.DataFrame({"doc": np.arange(len(texts)), "text": texts})])))
    assert len(calls) < 12                         # a few steps a group of texts, none a text
    plain = []
    for doc, t in enumerate(texts):
        h = substring.run_hashes(substring.word_hashes(t), substring.K).tolist()
        w = min(substring.WINDOW, len(h))
        at = sorted({i for lo in range(len(h) - w + 1) for i in range(lo, lo + w) if h[i] == min(h[lo:lo + w])}) if h else []
        seen: dict = {}
        for i in at:
            n = seen[h[i]] = seen.get(h[i], -1) + 1
            plain.append(((h[i] + n * 0xD1B54A32D192ED03) % 2**64, doc, i))
            if n:
                plain.append((h[i], doc, i))
    assert sorted(zip(got["seed"].to_numpy().view(np.uint64).tolist(), got["doc"], got["pos"])) == sorted(plain)


def test_chains_of_sets_apart_are_those_of_whole_pairs(monkeypatch):
    r = np.random.default_rng(22)
    n, far = 900, 2500
    doc, owner = r.integers(5, 8, n), r.integers(0, 2, n)
    px, py = r.integers(0, far, n), r.integers(0, far, n)
    near = r.random(n) < 0.6
    py[near] = px[near] + r.integers(0, 3, near.sum())
    sizes = []
    monkeypatch.setattr(substring, "chains", lambda s, f=substring.chains: sizes.append(len(s)) or f(s))
    got = sorted((d, o, *ends, *seg.tolist()) for d, o, *ends, seg in substring._chain_columns(doc, owner, px, py))
    split, plain, widest = max(sizes), [], 0
    for d, o in {*zip(doc.tolist(), owner.tolist())}:
        at = (doc == d) & (owner == o)
        _, _, seg = substring.segments(doc[at], owner[at], px[at], py[at])
        widest = max(widest, len(seg))
        for chain in substring.chains(seg):
            s = seg[chain]
            x0, x1 = int(s[0, 0]), int(s[-1, 0] + s[-1, 2])
            if x1 - x0 > substring.K:
                plain.append((d, o, x0, x1, int(s[0, 1]), int(s[-1, 1] + s[-1, 2]), *s.ravel().tolist()))
    assert got == sorted(plain) and len(got) > 20 and split < widest / 2
    # single seeds that lie apart are never chained one by one
    sizes.clear()
    at = np.arange(1000) * 50
    assert substring._chain_columns(np.ones(1000, int), np.zeros(1000, int), at, at[::-1]) == [] and not sizes


def test_stretches_and_chains_come_from_one_pass():
    rows = pd.DataFrame({"doc": [2] * 24 + [3], "owner": [1] * 24 + [3], "pos": [*range(0, 96, 4), 5], "opos": [*range(7, 103, 4), 5]})
    mixed = rows.sample(frac=1, random_state=3).sort_values("doc", kind="stable")
    out = pd.concat(substring._shared_rows(mixed.iloc[i:i + 7] for i in range(0, 25, 7)))
    chain, = out[~out["stretch"]].itertuples(index=False)
    assert chain[:6] == (2, 1, 0, 97, 7, 104) and list(chain.seg) == [0, 7, 97]
    assert out[out["stretch"]][["doc", "x0", "x1"]].values.tolist() == [[2, 0, 100]]


def test_matches_equal_the_plain_table():
    r = np.random.default_rng(12)
    for n, m, kinds in [(0, 5, 3), (1, 1, 1), *((int(r.integers(1, 90)), int(r.integers(1, 90)), int(r.integers(1, 30))) for _ in range(80))]:
        a, b = r.integers(0, kinds, n), r.integers(0, kinds, m)
        table = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert substring._matches(a, b) == table[n, m]


def test_a_gap_costs_a_few_steps_a_word(monkeypatch):
    calls = []
    monkeypatch.setattr(substring.np, "concatenate", lambda *a, f=np.concatenate, **k: calls.append(1) or f(*a, **k))
    words = np.arange(400)
    assert substring._matches(words, words[::-1]) == 1 and len(calls) < 10    # no array a word


def test_runs_come_to_the_driver_as_bytes(spark):
    runs = spark.range(200_000).select(F.xxhash64("id").alias("run"))
    tracemalloc.start()
    keys = substring._gathered(runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) == 200_000 and (np.diff(keys) > 0).all() and peak < 200_000 * 40
    assert set(keys.tolist()) == {r.run for r in runs.collect()}
    assert len(substring._gathered(runs.limit(0))) == 0


def test_cut_passages_keeps_the_rest():
    assert substring.cut_passages("  a b\tc  d\n", [(1, 3)]) == "  a d\n"
    assert substring.cut_passages("a b", [(0, 2)]) == "" and substring.cut_passages("", [(0, 1)]) == ""


def covered(rows, i, of):
    """Words of document i that passages report, against documents for which ``of`` holds."""
    out = set()
    for r in rows:
        if r.doc_id == i and of(r.other_id):
            out |= set(range(r.start, r.end))
        if r.other_id == i and of(r.doc_id):
            out |= set(range(r.ostart, r.oend))
    return out


def test_passages_whose_ends_a_third_document_quotes(spark):
    texts = []
    for k in range(30):
        p = words(55, 2000 + k).split()
        quotes = " ".join([words(30, 2100 + k), *p[:20], words(30, 2200 + k), *p[-20:], words(30, 2300 + k)])
        texts += [quotes, words(40, 2400 + k) + " " + " ".join(p), " ".join(p) + " " + words(40, 2500 + k)]
    rows = substring.passages(frame(spark, texts, list(range(90)))).collect()
    for k in range(30):
        b, c = 3 * k + 1, 3 * k + 2
        assert set(range(40, 95)) <= covered(rows, b, lambda o: o == c) and set(range(55)) <= covered(rows, c, lambda o: o == b)


def test_passages_held_twice(spark):
    texts = []
    for k in range(12):
        p, q = words(100, 2600 + k), words(60, 2700 + k)
        half = " ".join(q.split()[:30])
        texts += [" ".join([words(70, 2800 + k), p, words(70, 2900 + k), p, words(20, 3000 + k)]), words(35, 3100 + k) + " " + p,
                  " ".join([half, words(80, 3200 + k), q, words(20, 3300 + k)]), words(25, 3400 + k) + " " + q]
    docs = frame(spark, texts, list(range(48)))
    rows = substring.passages(docs).collect()
    left = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    for k in range(12):
        a, b, c, d = range(4 * k, 4 * k + 4)
        if any(r.doc_id == a for r in rows):
            assert {*range(70, 170), *range(240, 340)} <= covered(rows, a, lambda o: o == b)
        p, q = words(100, 2600 + k), words(60, 2700 + k)
        assert not (p in left[a] and p in left.get(b, "")) and not (q in left[c] and q in left.get(d, ""))
        assert any({r.doc_id, r.other_id} == {c, d} for r in rows)


def test_widest_passage_around_a_segment():
    r = random.Random(9)
    for _ in range(300):
        n, m = r.randrange(0, 40), r.randrange(0, 40)
        same = np.array([r.random() < 0.6 for _ in range(n)] + [True] * 50 + [r.random() < 0.6 for _ in range(m)])
        a = np.arange(len(same))
        b = np.where(same, a, -1)
        (x0, x1, y0, y1, equal), = substring._within(a, b, n, n, n + 50, n + 50, 50)
        best = max(j - i for i in range(n + 1) for j in range(n + 50, len(same) + 1) if same[i] and same[j - 1]
                   and same[i:j].sum() >= 0.8 * (j - i) - 1e-9)
        assert (x0, x1) == (y0, y1) and x1 - x0 == best and equal == same[x0:x1].sum() and same[x0] and same[x1 - 1]


def test_ranges_kept_hold_all_words():
    r = random.Random(4)
    for _ in range(200):
        lo = np.array([r.randrange(80) for _ in range(r.randrange(1, 20))])
        hi, doc = lo + np.array([r.randrange(3, 15) for _ in lo]), np.array([r.randrange(2) for _ in lo])
        kept = substring._cover(doc, doc, lo, hi)
        for d in set(doc):
            held = [{w for i in of if doc[i] == d for w in range(lo[i], hi[i])} for of in (range(len(lo)), kept)]
            assert held[0] == held[1]
    assert len(substring._cover(np.zeros(100, int), np.zeros(100, int), np.arange(100), np.arange(100) + 50)) == 3


@pytest.mark.parametrize("changed", ["replaced", "mixed"])
def test_passages_with_changed_words(spark, changed):
    r, texts = random.Random(6), []
    kinds = [(n, rate) for n in (50, 70, 100) for rate in (0.05, 0.1, 0.15, 0.2) for _ in range(10)]
    for k, (n, rate) in enumerate(kinds):
        p = words(n, 4000 + k, 5000).split()
        q = list(p)
        for i in r.sample(range(1, n - 1), round(n * rate) - (changed == "mixed")):
            q[i] = "new%d" % r.randrange(10**9)
        if changed == "mixed":
            q.insert(n // 2, "more%d" % k)
        texts += [" ".join([words(60, 5000 + k, 5000), *p, words(60, 6000 + k, 5000)]),
                  " ".join([words(80, 7000 + k, 5000), *q, words(70, 8000 + k, 5000)])]
    rows = substring.passages(frame(spark, texts, list(range(len(texts))))).collect()
    assert all(r.equal >= 0.8 * max(r.end - r.start, r.oend - r.ostart) and max(r.end - r.start, r.oend - r.ostart) >= 50 for r in rows)
    found = {frozenset((r.doc_id, r.other_id)) for r in rows}
    missed = Counter(kinds[k] for k in range(len(kinds)) if frozenset((2 * k, 2 * k + 1)) not in found)
    assert sum(missed.values()) <= 0.02 * len(kinds), missed
    assert len(rows) == len({(r.doc_id, r.other_id, r.start, r.end) for r in rows}) and len(rows) <= 1.1 * len(kinds)


def test_passages_are_cut_once(spark):
    p = words(80, 9100)
    docs = frame(spark, [words(40, 9101) + " " + p, p + " " + words(40, 9102), p, None], [1, 2, 3, 4])
    left = substring.without_repeats(docs)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan       # a second one takes another Python worker of every task
    got = [r.text for r in left.collect()]
    assert None in got and sum(len(t.split()) for t in got if t) == 160


def test_training_lets_go_what_a_worker_kept():
    common.kept(("earlier",), lambda: [0])
    got = next(toxicity._feature_rows(iter([pd.DataFrame({"p": [1], "text": ["a bad word"]})])))
    assert not common._KEPT
    assert np.frombuffer(got["f"][0], np.int64).tolist() == toxicity.features("a bad word").tolist()


def test_features_counted_in_slabs(monkeypatch):
    r = random.Random(8)
    rows = [np.array(sorted(r.sample(range(60), r.randrange(12))), np.int64) for _ in range(50)]
    names = np.arange(5, 70, 3)
    monkeypatch.setattr(toxicity, "SLAB", 7)
    assert toxicity.holding(names, rows).tolist() == [sum(n in x for x in rows) for n in names.tolist()]
    assert toxicity.holding(names[:0], rows).tolist() == []
