"""Byte-level BPE, hard negatives and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import hard_negatives, media, mixing, queries, secret_scan, sharding, spelling
from lexigrid.llm.byte_bpe import ByteBPE, bpe_decode, bpe_encode, byte_bpe

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RANKS = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    return byte_bpe(RANKS).library


# --- byte-level BPE


@pytest.mark.parametrize(("leaf", "window"), [(3, 4), (7, 4), (16, 64)])
def test_tree_equals_the_library(library, leaf, window):
    """Leaves of a few characters, so that every kind of border is joined; small windows, so that long matches are joined by tokens."""
    rng, bpe = random.Random(leaf), ByteBPE(RANKS, leaf, window)
    pieces = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "'re", "'v", "e", "é", "日", "本", "。", "1", "23", ".", "!!", "\x1c", " ", "\xa0", "ß", "😀", "_", "́", "''", "\U0001e922"]
    for _ in range(1500):
        own = rng.sample(pieces, rng.randint(1, len(pieces)))
        text = "".join(rng.choice(own) for _ in range(rng.randint(0, 100)))
        ids = bpe.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text
        assert bpe.decode(ids, leaf=3) == text.encode()
    for _ in range(150):
        text = "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(20, 300)))
        assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_merges_alone_equal_the_library(library):
    rng, bpe = random.Random(5), byte_bpe(RANKS)
    for _ in range(2000):
        word = "".join(rng.choice("abcdeinrstéß") for _ in range(rng.randint(1, 60)))
        assert bpe.merged(word.encode()) == library.encode_ordinary(word)


def test_texts_of_one_long_match(library):
    rng, bpe = random.Random(7), byte_bpe(RANKS)
    for text in ("a" * 30_000, "x" + " " * 20_001 + "y", "\n" * 9_000 + "a", "." * 20_000, "日" * 9_000, "".join(rng.choice("abcdeéinrst") for _ in range(40_000))):
        assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def odd_texts():
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "don't", "12", "日本", "  x", "ünder"]) for _ in range(5_000))
    return [None, "", " ", "a", long, long, long + " end", "b" * 9_000, "<|endoftext|>", "tail \n\n "]


def test_encode_and_decode_odd_rows(spark, library):
    df = spark.createDataFrame([(i, t, 7, "mine") for i, t in enumerate(odd_texts())] + [(None, "null id", 1, None)], "doc_id long, text string, n_tokens int, `__text` string")
    out = bpe_encode(df, segment_chars=1_000)
    assert sorted(out.columns) == ["__text", "doc_id", "ids", "n_tokens"]
    texts = dict(enumerate(odd_texts())) | {None: "null id"}
    for r in bpe_decode(out).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r["__text"] == (None if r.doc_id is None else "mine")
    assert out.count() == len(odd_texts()) + 1
    assert bpe_decode(bpe_encode(df.filter("false"))).count() == 0


def test_decode_of_ids(spark):
    ids = byte_bpe(RANKS).library.encode_ordinary("日本")
    df = spark.createDataFrame([(1, None), (2, []), (3, ids[:1])], "k int, ids array<int>")
    out = {r.k: r.decoded for r in bpe_decode(df).collect()}
    assert out[1] is None and bytes(out[2]) == b"" and "日本".encode().startswith(bytes(out[3]))
    with pytest.raises(Exception, match="no such id"):
        bpe_decode(spark.createDataFrame([([50_256],)], "ids array<int>")).collect()


def test_op11_by_hand(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op11_byte_bpe(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(texts.keys())
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- hard negatives


def mined(rows, positives=5, negatives=3, low=50, high=95):
    """By plain loops over Python's whole numbers; rows are (vec_id, vector, label)."""
    ok = [(u, i, [int(np.floor(np.float64(x) * 256)) for x in v], c) for u, (i, v, c) in enumerate(rows) if None not in (i, v, c) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for u, i, v, c in ok:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, c == d) for t, j, w, d in ok if t != u and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            found = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, k, n, -s, -m) for k, (m, n, _) in enumerate(found[:negatives], 1)]
    return sorted(out)


def made(seed, n, dim, labels=3, scale=1.0):
    rng = random.Random(seed)
    return [(rng.randrange(120), [rng.choice([-0.5, 0.0, 0.25, 0.7, 1.0]) * scale for _ in range(dim)], rng.randrange(labels)) for _ in range(n)]


@pytest.mark.parametrize(("rows", "round_bytes", "block"), [
    (made(1, 200, 4), 32 << 20, 1024),
    (made(2, 200, 2), 400, 3),  # many ties, rounds of a few anchors, blocks of three rows
    (made(3, 90, 3, scale=2.0**18), 32 << 20, 16),  # past what float64 holds exactly
    ([(0, [1.0, 0.5], 1)] * 9 + [(7, [1.0, 0.5], 2)] * 9 + [(3, [0.7, 0.5], 2)] * 3, 32 << 20, 4),  # copies
])
def test_hard_negatives_equal_brute_force(spark, rows, round_bytes, block):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, round_bytes=round_bytes, block=block)
    got = sorted(map(tuple, out.collect()))
    assert got == mined(rows) and (got or len(rows) == 21)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(4, 60, 3) + [(None, [1.0, 1.0, 1.0], 1), (50, None, 1), (50, [1.0, None, 0.0], 1), (50, [nan, 1.0, 1.0], 1), (100, [inf, 1.0, 1.0], 0), (100, [1.0, 1.0, 1.0], None), (50, [], 1), (51, [], 1), (52, [], 2), (50, [1.0, 1.0], 0), (8, [1.0, 1.0], 0), (9, [1.0, 0.5], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, uid string, q int")
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == mined(rows) and (50, 51, 1, 52, 0, 0) in got and (50, 8, 1, 9, 131072, 98304) in got
    none = hard_negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 50 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e16], 1), (1, [1e16], 1)], "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 50 == 0).collect()


def test_windows_of_scores():
    for s in range(-300, 300):
        low, high = hard_negatives.window_of(np.array([s]), 50, 95)
        assert [n for n in range(-400, 400) if 50 * s <= 100 * n <= 95 * s] == [n for n in range(-400, 400) if low[0] <= n <= high[0]]


def test_op12_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(map(tuple, queries.queries()["op12_hard_negatives"](spark, SF).collect())) == sorted(con.execute(hard_negatives.OP12_SQL).fetchall())


# --- spelling variants


def words_by_hand(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts):
    form, by_length, out = {}, {}, []
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    n_near = {}
    for w, n in counts.items():
        found = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        n_near[w] = len(found)
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return sorted(out, key=str)


def test_op13_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_spelling(spark, SF).collect()), key=str)
    assert got == variants_by_hand(words_by_hand(docs)) and any(r[1] for r in got)


@pytest.mark.parametrize(("seed", "letters", "lengths"), [(1, "ab", (4, 9)), (2, "abc", (5, 7)), (3, "abàÿz", (4, 6))])
def test_variants_of_words_with_repeated_bigrams(spark, seed, letters, lengths):
    """Few letters, so that words hold one bigram often, many are near, and counts tie."""
    rng = random.Random(seed)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice([3, 3, 5, 6, 12, 24, 50, 100, 200]) for _ in range(500)}
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n int"))
    assert sorted(map(tuple, got.collect()), key=str) == variants_by_hand(counts)


def test_chains_of_forms_and_odd_tables(spark):
    chain = {"a" * k + "bcdef": 3 * 2 ** (k % 40) for k in range(40)}
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {"a" * 39 + "bcdef"} and got["bcdef"].form == "abcdef" and got["a" * 39 + "bcdef"].form_n is None
    odd = [(None, "straße Straße STRAßE x", "z"), (1, None, "z"), (1, "", "z"), (2, "straße " * 2_000 + "strase strase strase", "z"), (2, "straße " * 2_000 + "strase strase strase", "z")]
    df = spark.createDataFrame(odd, "doc_id long, text string, word string")
    counts = spelling.word_counts(df)
    assert {r.word: r.n for r in counts.collect()} == words_by_hand([r[:2] for r in odd])
    assert sorted(map(tuple, spelling.spelling_variants(counts).collect()), key=str) == variants_by_hand(words_by_hand([r[:2] for r in odd]))
    assert spelling.spelling_variants(spelling.word_counts(df.filter("false"))).count() == 0
    with pytest.raises(Exception, match="four code points"):
        spelling.spelling_variants(spark.createDataFrame([("abc", 3)], "word string, n long")).collect()


# --- earlier operators


def test_equal_rows_are_dealt_like_others(spark):
    """A thousand equal rows among eight thousand: some 125 a shard, within chance (sd 10)."""
    rows = [(i, f"text {i}") for i in range(3_500)] + [(None, "same")] * 1_000 + [(i, f"text {i}") for i in range(3_500, 7_000)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).filter("text = 'same'").collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 1_000 and len(counts) == 8 and all(80 <= n <= 170 for n in counts.values())
    slots = sorted(r.slot for r in out if r.shard == 0)
    assert slots[-1] - slots[0] > 500


def test_a_borrower_alone_ends_the_job(spark, tmp_path):
    long = " ".join(str(i * i) for i in range(30_000))
    stored = media.store(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string"), str(tmp_path / "m"))
    assert media.read_media(stored).count() == 2
    borrower = stored.filter(F.exists("chunks", lambda c: c["bytes"].isNull()))
    assert borrower.count() == 1
    with pytest.raises(Exception, match="none of the containers"):
        media.read_media(borrower).collect()


def test_draws_of_the_mix_follow_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 5), f"s{i % 3}") for i in range(3_000)], "doc_id long, text string, source string")
    draws = Counter(d.shard for r in mixing.mix(docs, block_rows=4, n_shards=8).collect() for d in r.draws)
    assert set(draws) == set(range(8)) and max(draws.values()) < 1.3 * min(draws.values())
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, n, rng: [list(quotas)] + [[0] * len(quotas)] * (n - 1))
    assert {d.shard for r in mixing.mix(docs, block_rows=4, n_shards=8).collect() for d in r.draws} == {0}


def test_op9_says_the_shards(spark):
    for r in queries.op9_mixing(spark, SF).collect():
        shards = [int(s) for s in r.shards.split(",") if s]
        assert r.taken == len(shards) * r["size"] and all(0 <= s < 16 for s in shards)


def test_gradient_of_the_field_by_differences():
    """Sequences of several lengths, padded to one; the differences are taken from sums over all paths."""
    rng = np.random.default_rng(0)
    model = secret_scan.Field()
    model.shape[:] = rng.normal(size=model.shape.shape) * 0.3
    model.file[:] = rng.normal(size=model.file.shape) * 0.3
    allowed = model.moves > -1e8
    model.moves[allowed] = rng.normal(size=allowed.sum())
    matrix = np.vstack([np.zeros(len(secret_scan.NAMES)), (rng.random((5, len(secret_scan.NAMES))) < 0.3).astype(float)])
    lengths, tags = [5, 3, 1], np.array([[0, 1, 2, 0, 1], [1, 2, 0, 0, 0], [0, 0, 0, 0, 0]])
    ids = np.zeros((3, 8), int)
    for row, n in enumerate(lengths):
        ids[row, 2 : 2 + n] = rng.integers(1, 6, n)
    at, files = [ids[:, 2 + p : 7 + p] for p in secret_scan.PLACES], np.array([0, 3, 1])

    def plain():
        by, total = model.by_shape(matrix), 0.0
        for row, n in enumerate(lengths):
            e = [sum(b[i[row, t]] for b, i in zip(by, at, strict=True)) + model.file[files[row]] for t in range(n)]
            score = lambda path: sum(e[t][y] + model.moves[path[t - 1] if t else 0, y] for t, y in enumerate(path))  # noqa: B023, E731
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=n))) - score(tags[row, :n])
        return total

    value, grads = secret_scan.gradient(model, matrix, at, tags, files)
    assert value == pytest.approx(plain())
    for x, g in zip((model.shape, model.file, model.moves), grads, strict=True):
        for place in zip(*np.nonzero(np.ones(x.shape)), strict=True):
            if x is model.moves and not allowed[place]:
                continue
            old, values = x[place], []
            for step in (1e-5, -1e-5):
                x[place] = old + step
                values.append(plain())
            x[place] = old
            assert g[place] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)
