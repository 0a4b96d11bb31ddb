"""The registered queries over whole tables, and the pipeline stage by stage against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import re
import wave
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import queries, secret_scan, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_sharding", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}),
    ("op2_toxicity", {"doc_id", "held_out", "score", "predicted"}),
    ("op3_token_counts", {"doc_id", "n_bytes", "n_tokens", "over_limit"}),
    ("op5_language_id", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op7_secrets", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
    ("op9_mixing", {"doc_id", "size", "source_size", "target", "taken", "shards"}),
    ("op10_media", {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}),
])
def test_one_row_per_document(spark, table, name, columns):
    out = queries.queries()[name](spark, SF)
    assert set(out.columns) == columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(table.keys())


def text_of(table, i):
    return table[i].text or ""


def test_sharding_by_hand(spark, table):
    out = queries.op1_sharding(spark, SF).collect()
    for r in out:
        data = text_of(table, r.doc_id).encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert Counter((r.shard, r.slot) for r in out) == Counter((s, k) for s, n in counts.items() for k in range(n))
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))] != sorted(table)


def test_toxicity_by_hand(spark, table):
    """Scores are the logistic of bias and weights over words and beginnings, by a plain loop; labels of the held-out third play no part."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, ~toxicity.held_out())
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, wrong, ~toxicity.held_out()) == model
    for r in queries.op2_toxicity(spark, SF).collect():
        words = set(re.findall(rb"[a-z\x80-\xff]+", text_of(table, r.doc_id).encode().lower()))
        words |= {b"^" + w[:k] for w in words if len(w) > 5 for k in (4, 5)}
        z = model.bias + sum(model.weights.get(w, 0.0) for w in words)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z))))) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_token_counts_by_hand(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(t.encode(text_of(table, r.doc_id), add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text_of(table, r.doc_id).encode()), n, n > 2048)


def test_secrets_by_hand(spark):
    sf = SF.replace("sf0.001", "sf0.01")  # the smallest table has no secret
    table = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = {"assign": (re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 1, 8), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}
    found = 0
    for r in queries.op7_secrets(spark, sf).collect():
        spans = sorted((m.start(), k, name, m.end()) for k, (name, (p, g, n)) in enumerate(kinds.items()) for m in p.finditer(text_of(table, r.doc_id)) if len(m[g]) >= n)
        listed = [f"{name}:{a}:{z}" for a, _, name, z in spans]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(name == k for _, _, name, _ in spans) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and all(re.fullmatch(r"crf:\d+:\d+", x) for x in spans if x not in listed)
        found += len(listed)
    assert found


def test_packing_by_hand(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = {}, {}
    for r in queries.op8_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == table.keys()
    for i, rows in pieces.items():
        ids = [*t.encode(text_of(table, i), add_special_tokens=False).ids, 2]
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids) and all(r.length == 1024 for r in rows[1:])
        at = 0
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for items in places.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 1024


def test_mixing_by_hand(spark, table):
    size = {i: len(text_of(table, i).encode().split()) for i in table}
    sources = sorted({r.source for r in table.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, r in table.items() if r.source == s) for s in sources}
    target, free, left = {}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}, 1.5 * sum(size.values())
    while over := [s for s in free if left * free[s] / sum(free.values()) > 2 * total[s]]:
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    taken = Counter()
    for r in queries.op9_mixing(spark, SF).collect():
        s = table[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert max(abs(taken[s] - target[s]) / max(target[s], 1) for s in sources) <= 0.02


def test_media_by_hand(spark, table, tmp_path):
    for r in queries.op10_media(spark, SF).collect():
        data = text_of(table, r.doc_id).encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        with wave.open(str(tmp_path / "x.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        media = (tmp_path / "x.wav").read_bytes()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        mean = sum(payload) / len(payload)
        rms = math.sqrt(sum((x - 128) ** 2 for x in payload) / len(payload))
        turns = sum((x < 128) != (y < 128) for x, y in zip(payload, payload[1:], strict=False))
        hist = [sum(64 * k <= x < 64 * (k + 1) for x in payload) for k in range(4)]
        assert r.feature == f"n={len(payload)};s={len(payload) / 8000:.4f};mean={mean:.6f};rms={rms:.6f};zc={turns};hist={'/'.join(map(str, hist))}"


def test_language_held_out_accuracy(spark, table):
    out = [r for r in queries.op5_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == table[r.doc_id].lang for r in out]) > 0.95


def test_pipeline_stages(spark, table, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in found["language_id"]}
    assert len(kept) >= 0.98 * len(table) and all(r == table[r.doc_id] for r in found["language_id"])

    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i in kept if (w := (table[i].text or "").encode().lower().split())}
    up = {i: i for i in kept}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) * 100 >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert {r.doc_id for r in found["ngram_join"]} == {i for i in kept if find(i) == i}

    for r in found["secret_scan"]:
        old = table[r.doc_id].text
        spans = secret_scan.base_spans(old, old.encode().split())
        assert not any(old[a:z] in r.text for a, _, z in spans) and (spans or "<secret>" in r.text or r.text == old) and r.n_chars == len(r.text)
    size = {r.doc_id: len(r.text.encode().split()) for r in found["secret_scan"]}
    drawn = Counter(r.doc_id for r in found["mixing"])
    assert max(drawn.values()) <= 2 and drawn.keys() <= size.keys()
    assert sum(size[i] * n for i, n in drawn.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    packed = Counter(r.doc_id for r in found["packing"] if r.piece == 0)
    assert packed == drawn
    fill = Counter()
    for r in found["packing"]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.05 * sum(fill.values()) / 1024 + 1


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def written_docs(spark, rows, path):
    spark.createDataFrame(rows, ODD).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_gives_the_last_stage(spark, table, tmp_path):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "secret_scan", "mixing", "packing"]
    rows = [tuple(r) for r in sorted(table.values())[:80]]
    rows += [(None, None, None, None, None), (5000, "", "en", "s", 0), (5001, None, None, None, None), rows[0], rows[3][:1] + (rows[4][1],) + rows[3][2:], (None, rows[5][1], "en", None, 3), (5002, "12 ; 34", "en", "s", 7)]
    out = corpus_pipeline.run(spark, written_docs(spark, rows, tmp_path / "odd")).collect()
    assert out and set(out[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert {r.doc_id for r in out} <= {r[0] for r in rows} - {5000, 5001, 5002}
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) == max(o + n for o, n in x) <= 1024 for x in places.values())
    assert corpus_pipeline.run(spark, written_docs(spark, [], tmp_path / "none")).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_odd_rows(spark, k):
    """Nulls in any column, repeated rows and an empty table go through each stage."""
    name, stage = corpus_pipeline.STAGES[k]
    rows = [(i, f"the house and the garden are near number {i} of the long street by the water", "en", f"s{i % 3}", 5) for i in range(40)]
    rows += [(None, None, None, None, None), (7, None, None, None, None), rows[3], (None, rows[4][1], "en", None, None), (60, "", "en", "s1", 0)]
    clashing = ["score", "size", "shard", "place", "lang_pred", "draws", "__text"]
    out = stage(spark, spark.createDataFrame(rows, ODD).withColumns({c: F.lit("mine") for c in clashing}), SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *clashing]
    assert out.filter(" or ".join(f"`{c}` is null or `{c}` <> 'mine'" for c in clashing)).count() == 0
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter((r[0], r[1]) for r in rows)
    if name == "language_id":
        assert got == Counter({x: n for x, n in want.items() if x[1]})
    elif name == "ngram_join":
        assert max(got.values()) == 1 and (None, rows[4][1]) not in got and (None, None) in got and (60, "") in got
    elif name == "secret_scan":
        assert got == want
    else:
        assert set(got) <= set(want)
    assert stage(spark, spark.createDataFrame([], ODD), SF).count() == 0
