"""Token counts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is counted where it lies. A longer one is cut into
overlapping chunks, which become rows of their own, so that one huge document keeps many tasks busy and
none holds it whole. Each chunk is encoded with offsets. Two neighbours are spliced at a boundary inside
their overlap where both encodings start a token right after white space: the tokenizer drops white space
and never joins across it, so what it does on either side of such a place is independent of the other
side. Where an overlap has no such place, the document is encoded again with a wider overlap, in the end
as one chunk.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, carried, fields_of, shielded, sliced, utf8, written

#: Words kept with their counts by a worker, some 50 MB; beyond it the memory starts anew.
MEMO_WORDS = 300_000
SPACES = " \t\n\x0b\x0c\r"

_loaded: dict[str, tuple] = {}
_counted: dict[str, dict[bytes, int]] = {}


def separable(settings: dict) -> bool:
    """Whether a tokenizer file provably splits at ASCII white space and drops it, whatever stands beside it.

    So it is where the normalizer works by the character or on runs of white space, and the first step of the
    pre-tokenizer keeps only the matches of a pattern that takes in no white space.
    """
    import regex

    normalizer = settings.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for n in normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]:
        if n["type"] not in ("NFC", "NFD", "Lowercase", "StripAccents") and not (n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " "):
            return False
    first = settings.get("pre_tokenizer") or {"type": None}
    first = first["pretokenizers"][0] if first["type"] == "Sequence" else first
    if first["type"] != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or "Regex" not in first["pattern"]:
        return False
    around = ["", "a", "Z", "é", "日", "1", ".", "'", "-", "\u0301", "'s", "_"]
    return not any(c in m for c in SPACES for x in around for y in around for m in regex.findall(first["pattern"]["Regex"], x + c + y))


def tokenizer(name: str):
    """The tokenizer of a file (a path, or a name known to public_tokenizers), its special strings, and whether it is separable; once a worker."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, encoding="utf-8") as f:
            _loaded[name] = (t, [a.content for a in t.get_added_tokens_decoder().values()], separable(json.load(f)))
    return _loaded[name]


def count_texts(texts: list[str | None], name: str, memo: dict[bytes, int]) -> list[int]:
    """Tokens of each text.

    With a separable tokenizer, texts without special strings are summed over words cut at ASCII white space,
    each encoded once and remembered in ``memo``; all others are encoded whole.
    """
    t, special, by_word = tokenizer(name)
    split: list = []
    for text in texts:
        if text is None:
            split.append([])
        elif not by_word or any(s in text for s in special):
            split.append(len(t.encode(text, add_special_tokens=False).ids))
        else:
            split.append(utf8(text).split())
    if len(memo) > MEMO_WORDS:
        memo.clear()
    new = set().union(*(w for w in split if isinstance(w, list))) - memo.keys()
    for part in _parts(sorted(new), 5_000):
        memo.update(zip(part, (len(e.ids) for e in t.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)), strict=True))
    return [w if isinstance(w, int) else sum(map(memo.__getitem__, w)) for w in split]


def _parts(xs: list, n: int) -> Iterator[list]:
    for i in range(0, len(xs), n):
        yield xs[i : i + n]


def chunk_marks(text: str, start: int, left: int, right: int, name: str) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Encodes a chunk that starts at character ``start`` of its document.

    Gives its token count and, for its first ``left`` and its characters from ``right`` on, the document
    offsets at which a token follows white space, with the number of the chunk's tokens before each.
    """
    t, _, _ = tokenizer(name)
    offsets = t.encode(text, add_special_tokens=False).offsets
    heads: tuple[list[int], list[int]] = ([], [])
    tails: tuple[list[int], list[int]] = ([], [])
    for k, (a, _) in enumerate(offsets):
        if a and text[a - 1] in SPACES and (k == 0 or offsets[k - 1][1] < a):
            for marks, inside in ((heads, a < left), (tails, a >= right)):
                if inside:
                    marks[0].append(start + a)
                    marks[1].append(k)
    return len(offsets), *heads, *tails


def spliced(chunks: list[dict]) -> int | None:
    """Tokens of a document from its chunks in order; None where two neighbours share no boundary."""
    total, begun = 0, 0
    for this, after in zip(chunks, [*chunks[1:], None], strict=True):
        if after is None:
            return total + this["n"] - begun
        theirs = dict(zip(after["head_at"], after["head_k"], strict=True))
        shared = next(((k, theirs[at]) for at, k in zip(this["tail_at"], this["tail_k"], strict=True) if at in theirs and k >= begun), None)
        if shared is None:
            return None
        total, begun = total + shared[0] - begun, shared[1]
    return total


def _count(name: str, names: list[str], body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _counted.setdefault(name, {})
        for b in sliced(batches, body, 4 << 20):
            counts = count_texts(b.column(body).to_pylist(), name, memo)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(counts, pa.int64())], [*names, "n_tokens"])

    return run


def _chunks(chunk: int, overlap: int):
    """Chunk k of a text holds the characters from k * chunk on, and the overlap after its end; one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, start in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([k], pa.int64()), pa.array([start], pa.int64()), pa.array([text[start : start + chunk + overlap]])], ["uid", "k", "start", "text"])

    return run


def _mark(name: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            out = [chunk_marks(x["text"], x["start"], overlap, chunk, name) for x in b.select(["text", "start"]).to_pylist()]
            cols = [pa.array([o[i] for o in out], pa.list_(pa.int64()) if i else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("k"), *cols], ["uid", "k", "n", "head_at", "head_k", "tail_at", "tail_k"])

    return run


def _splice(key: tuple[str], pdf: pd.DataFrame) -> pd.DataFrame:
    chunks = pdf.drop_duplicates("k").sort_values("k").to_dict("records")
    n = spliced(chunks)
    return pdf.head(1)[["uid"]].assign(n_tokens=-1 if n is None else n)


MARKS = "uid string, k long, n long, head_at array<long>, head_k array<long>, tail_at array<long>, tail_k array<long>"


def _huge_counts(huge: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """(uid, n_tokens) of documents over ``chunk`` characters; widens the overlap until every document is spliced."""
    scratch, done, left = Scratch(huge.sparkSession, "token-splice"), None, huge
    while True:
        # Equal texts have one uid: the exchange that deals the chunks out also makes them one.
        rows = left.mapInArrow(_chunks(chunk, overlap), "uid string, k long, start long, text string").groupBy("uid", "k").agg(F.first("start").alias("start"), F.first("text").alias("text"))
        marks = rows.mapInArrow(_mark(name, chunk, overlap), MARKS)
        counts = scratch.written(marks.groupBy("uid").applyInPandas(_splice, "uid string, n_tokens long"), "counts")
        failed = counts.filter("n_tokens < 0")
        good = counts.filter("n_tokens >= 0")
        done = good if done is None else done.unionByName(good)
        if failed.isEmpty():
            return done
        left = left.join(failed.select("uid"), "uid", "left_semi")
        chunk, overlap = min(chunk * 8, 2**30), min(overlap * 64, 2**29)


@shielded
def token_counts(docs: DataFrame, tokenizer_name: str = "word_bpe_49k.json", text_col: str = "text", chunk_chars: int = 32_768, overlap_chars: int = 2_048, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row (all but the text if not given) with n_bytes and n_tokens.

    A null or empty text has 0 bytes and 0 tokens; repeated rows stay and count alike; an empty table
    gives an empty one. Columns named n_bytes or n_tokens are replaced. No begin, end or added tokens;
    special strings inside a text count as the library treats them by default. A tokenizer for which no
    boundary can be proven stable (see separable) encodes every text whole.
    """
    docs = docs.drop("n_bytes", "n_tokens").withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_bytes", "n_tokens") and (keep or c != text_col)]
    base, names, body = carried(docs, text_col, [*keep, "n_bytes"], ("n_tokens",))
    out = T.StructType(fields_of(base, names) + [T.StructField("n_tokens", T.LongType())])
    is_huge = F.length(body) > chunk_chars
    if not tokenizer(tokenizer_name)[2]:
        return base.mapInArrow(_count(tokenizer_name, names, body), out)
    small = base.filter(~F.coalesce(is_huge, F.lit(False))).mapInArrow(_count(tokenizer_name, names, body), out)
    huge = written(base.filter(is_huge).withColumn("__uid", F.sha2(F.col(body).cast("binary"), 256)), "token-huge")
    if huge.isEmpty():
        return small
    counts = _huge_counts(huge.select(F.col("__uid").alias("uid"), F.col(body).alias("text")), tokenizer_name, chunk_chars, overlap_chars)
    return small.unionByName(huge.join(counts.withColumnRenamed("uid", "__uid"), "__uid").select(*(F.col(f"`{c}`") for c in names), "n_tokens"))
