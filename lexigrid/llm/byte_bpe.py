"""Byte-level BPE by monoid tree reduction.

encode is a map from texts to token sequences, and a text is the concatenation of its halves, so encode(a + b) can be
made from encode(a) and encode(b). A text is halved until its parts are short; these are encoded by the library; two
neighbours are joined by encoding a window around their border again. The window grows until what lies outside of it
is proven to stay as it is, on two levels:

* Matches of the pattern. A place where white space follows anything else, or where letters, digits and other ASCII
  characters meet (but for an apostrophe before a letter), lies inside no match of the pattern, whatever stands around
  it, and a scan that starts there depends on nothing before it. The window reaches to such a place, or the end, on
  either side. See CUT.
* Tokens of one long match. t1 ... tn are the tokens of their bytes if, and only if, each two neighbours are the tokens
  of their own bytes: merges go by the lowest rank, so inside a segment they happen in the same order whether or not the
  segment stands alone, up to the first merge across its border; and the first merge across any border would happen
  among the two tokens at it just the same. So a window of tokens is merged again and doubled until its outermost
  tokens agree with the ones beside them.

Texts over ``segment_chars`` are dealt out in segments, each a subtree of its own, and the subtrees of a text are joined
in one task from their ids. Decoding concatenates the bytes of the halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import but_text, carried, fields_of, shielded, sliced, table, utf8, written

#: Places that lie inside no match of the pattern and begin a scan of their own. The pattern takes white space only
#: before what it goes with, letters only with letters (and after ' in a contraction), digits only with digits.
CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[ぁ-ゖァ-ヺ一-鿿])(?=[、。，！？])")


class ByteBPE:
    """A rank file with the pattern that splits texts before the merges."""

    def __init__(self, name: str, leaf: int = 4_096, window: int = 4_096):
        import public_tokenizers
        import tiktoken

        path = name if os.path.sep in name else public_tokenizers.path(name)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        last = max(self.bytes_of)
        self.tokens = pa.array([self.bytes_of.get(i) for i in range(last + 1)], pa.binary())
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(last + 1)], np.int64)
        self.leaf, self.window = leaf, window

    # --- encoding

    def encode(self, text: str) -> np.ndarray:
        return self._node(text, 0, len(text))

    def _node(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return self._library(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self._node(text, a, m), self._node(text, m, b))

    def _library(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def join(self, text: str, a: int, p: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[a:b] from those of text[a:p] and of text[p:b]."""
        if a == p or p == b:
            return left if p == b else right
        s, q = self._cut_before(text, a, p), self._cut_after(text, p, b)
        if s == p or q == p:
            return np.concatenate([left, right])
        n, m = self._last_tokens(left, len(utf8(text[s:p]))), self._first_tokens(right, len(utf8(text[p:q])))
        keep = len(left) - n
        if q - s <= self.window or not all(map(_settled, set(text[s:q]))):
            middle = self._library(text[s:q])
        else:
            middle = self._long_window(text[s:q], p - s, left[keep:], right[:m])
        return np.concatenate([left[:keep], middle, right[m:]])

    def _cut_before(self, text: str, a: int, p: int) -> int:
        width = 64
        while True:
            lo = max(a, p - width)
            found = [m.start() for m in CUT.finditer(text[lo : p + 1])]
            if found or lo == a:
                return lo + found[-1] if found else a
            width *= 4

    def _cut_after(self, text: str, p: int, b: int) -> int:
        width = 64
        while True:
            hi = min(b, p + width)
            found = CUT.search(text[p - 1 : hi])
            if found or hi == b:
                return p - 1 + found.start() if found else b
            width *= 4

    def _last_tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        ends = np.cumsum(self.sizes[ids[-n_bytes:][::-1]])
        return self._exactly(ends, n_bytes)

    def _first_tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        return self._exactly(np.cumsum(self.sizes[ids[:n_bytes]]), n_bytes)

    @staticmethod
    def _exactly(ends: np.ndarray, n_bytes: int) -> int:
        k = int(np.searchsorted(ends, n_bytes))
        if ends[k] != n_bytes:
            raise AssertionError("a token lies across a place that no match can hold")
        return k + 1

    def _long_window(self, text: str, p: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of a window with few matches, one of which may be very long: what either half has encoded is used again."""
        spans = lambda x, at: [(m.start() + at, m.end() + at) for m in self.pattern.finditer(x)]
        known = self._by_span(text, spans(text[:p], 0), left) | self._by_span(text, spans(text[p:], p), right)
        out = []
        for span in spans(text, 0):
            if span in known:
                out.append(known[span])
            elif span[0] < p < span[1] and (span[0], p) in known and (p, span[1]) in known:
                out.append(self.join_match(known[span[0], p], known[p, span[1]]))
            else:
                out.append(self._library(text[slice(*span)]))
        return np.concatenate(out)

    def _by_span(self, text: str, spans: list[tuple[int, int]], ids: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        ends, at, out = np.cumsum(self.sizes[ids]), 0, {}
        done = 0
        for a, b in spans:
            done += len(utf8(text[a:b]))
            k = int(np.searchsorted(ends, done)) + 1
            out[a, b] = ids[at:k]
            at = k
        return out

    def join_match(self, left: np.ndarray, right: np.ndarray, width: int = 4) -> np.ndarray:
        """The ids of one match of more bytes than any token has, from those of its two parts."""
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.merged(self.decode(np.concatenate([left[a:], right[:b]])))
            if (a == 0 or self._agree(left[a - 1], middle[0])) and (b == len(right) or self._agree(middle[-1], right[b])):
                return np.concatenate([left[:a], np.array(middle, np.uint32), right[b:]])
            width *= 2

    def _agree(self, x: int, y: int) -> bool:
        return self.merged(self.bytes_of[int(x)] + self.bytes_of[int(y)]) == [x, y]

    def merged(self, data: bytes) -> list[int]:
        """The merges alone: the pair of lowest rank first, of equal ones the leftmost."""
        ranks, n = self.ranks, len(data)
        end, before = [i + 1 for i in range(n)], [i - 1 for i in range(n)]  # of the part that begins at i, -2 where none does
        pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, stop = heapq.heappop(pairs)
            if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(pairs, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(pairs, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    # --- decoding

    def decode(self, ids: np.ndarray, leaf: int = 1 << 16) -> bytes:
        if len(ids) > leaf:
            m = len(ids) // 2
            return self.decode(ids[:m], leaf) + self.decode(ids[m:], leaf)
        unknown = (ids < 0) | (ids >= len(self.sizes))
        if unknown.any() or not self.sizes[ids].all():
            raise ValueError(f"no such id in {ids[unknown][:1] if unknown.any() else ids[self.sizes[ids] == 0][:1]}")
        if not len(ids):
            return b""
        _, ends, data = self.tokens.take(pa.array(ids)).buffers()  # the bytes of all tokens lie one after the other
        return data.slice(0, int(np.frombuffer(ends, np.int32, len(ids) + 1)[-1])).to_pybytes()


def _settled(c: str) -> bool:
    """Whether a character has been in Unicode for so long, in the same class, that all libraries agree on it."""
    old = unicodedata.ucd_3_2_0.category(c)
    return old != "Cn" and old[0] == unicodedata.category(c)[0]


_loaded: dict[str, ByteBPE] = {}


def byte_bpe(name: str) -> ByteBPE:
    """The tokenizer of a rank file (a path, or a name known to public_tokenizers); once a worker."""
    if name not in _loaded:
        _loaded[name] = ByteBPE(name)
    return _loaded[name]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int32)))


def _encode(name: str, width: int, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(name)
        for b in sliced(batches, body):
            ids = [bpe.encode(t or "") for t in b.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), _lists(ids), pa.array([len(x) for x in ids], pa.int64())], [*b.schema.names[:width], "ids", "n_tokens"])

    return run


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, start in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([k], pa.int64()), pa.array([text[start : start + size]])], ["uid", "k", "text"])

    return run


def _joined(name: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One text: its segments are the leaves, joined by halves."""
        bpe = byte_bpe(name)
        ids = [np.asarray(x, np.uint32) for x in pdf.drop_duplicates("k").sort_values("k")["ids"]]
        parts = [bpe.decode(x).decode("utf-8", "surrogatepass") for x in ids]
        at, text = [0, *np.cumsum([len(p) for p in parts]).tolist()], "".join(parts)

        def node(i: int, j: int) -> np.ndarray:
            if j - i == 1:
                return ids[i]
            m = (i + j) // 2
            return bpe.join(text, at[i], at[m], at[j], node(i, m), node(m, j))

        return pd.DataFrame({"uid": pdf["uid"].iloc[:1], "ids": [node(0, len(ids)).astype(np.int32)]})

    return run


@shielded
def bpe_encode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", text_col: str = "text", keep: list[str] | None = None, segment_chars: int = 65_536) -> DataFrame:
    """The columns ``keep`` of each row (all but the text if not given) with ids (array of int) and n_tokens.

    Every whole text is encoded as tiktoken's encode_ordinary does it. A null or empty text has no ids; repeated rows
    stay, with equal ids; an empty table gives an empty one; columns named ids or n_tokens are replaced. A text over
    ``segment_chars`` is encoded in as many tasks as it has segments; equal ones once.
    """
    base, names, body = carried(docs, text_col, but_text(docs, text_col, keep), ("ids", "n_tokens"))
    out = T.StructType(fields_of(base, names)).add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long")
    is_huge = F.coalesce(F.length(body) > segment_chars, F.lit(False))
    small = base.filter(~is_huge).mapInArrow(_encode(ranks, len(names), body), out)
    huge = written(base.filter(is_huge).withColumn("__uid", F.sha2(F.col(body).cast("binary"), 256)), "bpe-huge")
    if huge.isEmpty():
        return small
    texts = huge.select(F.col("__uid").alias("uid"), F.col(body).alias("text")).mapInArrow(_segments(segment_chars), "uid string, k long, text string")
    segments = texts.groupBy("uid", "k").agg(F.first("text").alias("text"))
    encoded = segments.mapInArrow(_encode(ranks, 3, "text"), "uid string, k long, text string, ids array<int>, n_tokens long").select("uid", "k", "ids")
    joined = encoded.groupBy("uid").applyInPandas(_joined(ranks), "uid string, ids array<int>").withColumnRenamed("uid", "__uid")
    return small.unionByName(huge.join(joined, "__uid").select(*(F.col(f"`{c}`") for c in names), F.col("ids"), F.size("ids").cast("long").alias("n_tokens")))


@shielded
def bpe_decode(rows: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row (all if not given) with decoded (binary), the bytes that the ids stand for.

    Null ids give null, no ids give no bytes; an id that the ranks do not have ends the job with a ValueError. Tokens may
    end inside a character, so the bytes of some ids alone need not be UTF-8.
    """
    names = [c for c in (keep if keep is not None else rows.columns) if c != "decoded"]
    base = rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                ids = part.column("__ids")
                values, ends, null = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy(), ids.is_null().to_pylist()
                data = [None if null[i] else bpe.decode(values[ends[i] : ends[i + 1]]) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(data, pa.binary())], [*names, "decoded"])

    return base.mapInArrow(run, T.StructType(fields_of(base, names)).add("decoded", "binary"))


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe_decode(bpe_encode(docs))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
