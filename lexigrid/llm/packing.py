"""Best-fit packing with large-item matching.

A document is its token ids and an end id. One longer than the capacity is cut into pieces of the capacity,
the first of which may be shorter. Lengths are whole numbers up to the capacity, so the plan is made on the
driver from the number of pieces of each length, whatever the number of documents: pieces over a third of the
capacity are matched at most two to a sequence, the longest with the longest that fits; shorter ones, the
longest first, fill the smallest gap that holds them, and open new sequences only where none does. Each piece
then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import but_text, carried, fields_of, shielded, sliced, table, written

_encoders: dict[str, tuple] = {}


def byte_encoder(name: str):
    """(fast encoder, library's tokenizer, special strings) of a byte-level BPE file.

    The fast encoder reads the file's own vocabulary; byte-level BPE merges by rank, and a token's id is its
    rank there, so both give the same ids, which the tests hold it to. Texts with a special string or a run of
    RUN characters of one kind go to the library.
    """
    if name not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        special = {a.content for a in t.get_added_tokens_decoder().values()}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # Byte-level files write each byte as a printable character: those that are so already as themselves, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(as_byte[c] for c in w): i for w, i in vocabulary.items() if w not in special}
        fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[name] = (fast, t, sorted(special))
    return _encoders[name]


#: Longest run of one kind of character (white space, letters, digits, others) that goes to the fast encoder,
#: whose pattern backtracks over such a run and has a bounded stack.
RUN = 10_000
_LONG_RUN = re.compile(rf"\s{{{RUN}}}|\w{{{RUN}}}|[^\s\w]{{{RUN}}}")


def ids_of(text: str | None, name: str, end: int) -> np.ndarray:
    fast, library, special = byte_encoder(name)
    text = text or ""
    if any(s in text for s in special) or (len(text) >= RUN and _LONG_RUN.search(text)):
        ids = np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
    return np.append(ids, np.uint32(end))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of the capacity, but for a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset), where piece k of a run lies in the sequence of the same k; and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs (first sequence, number) of sequences with it
    used, sequences = dict.fromkeys(counts, 0), 0
    left = {s: c for s, c in counts.items() if c > 0}

    def place(size: int, n: int, first: int, gap: int) -> None:
        runs.append((size, used[size], n, first, capacity - gap))
        used[size] += n
        left[size] -= n
        gaps[gap - size].append((first, n))

    def opened(n: int) -> int:
        nonlocal sequences
        sequences += n
        return sequences - n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for i, size in enumerate(large):
        if left[size] and 2 * size <= capacity:
            n = left[size] // 2
            if n:
                first = opened(n)
                place(size, n, first, capacity)
                gaps[capacity - size].pop()
                place(size, n, first, capacity - size)
        for other in large[i + 1 :]:
            if not left[size]:
                break
            if size + other <= capacity and left[other]:
                n = min(left[size], left[other])
                first = opened(n)
                place(size, n, first, capacity)
                gaps[capacity - size].pop()
                place(other, n, first, capacity - size)
        if left[size]:
            n = left[size]
            place(size, n, opened(n), capacity)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        gap = size
        while left[size] and gap <= capacity:
            if not gaps[gap]:
                gap += 1
                continue
            first, n = gaps[gap].pop()
            take = min(n, left[size])
            if take < n:
                gaps[gap].append((first + take, n - take))
            place(size, take, first, gap)
            gap = max(size, min(gap, gap - size))  # what is left of that sequence may be the best fit of the next one
        while left[size]:
            whole = capacity // size
            n, rest = divmod(left[size], whole)
            first = opened(n or 1)
            for k in range(whole if n else rest):
                place(size, n or 1, first, capacity - k * size)
                if k:
                    gaps[capacity - k * size].pop(-1)
    return runs, sequences


def _pieces(name: str, end: int, capacity: int, with_ids: bool, width: int, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, body):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(b.column(body).to_pylist()):
                own = ids_of(text, name, end).astype("<u4")
                for k, (s, n) in enumerate(cut(len(own), capacity)):
                    data = own[s : s + n].tobytes()
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data))
                    ids.append(data)
            kept = b.take(pa.array(row, pa.int64()))
            cols = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *([pa.array(ids, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(width)), *cols], [*b.schema.names[:width], *PIECE.names[: len(cols)]])

    return run


PIECE = T.StructType().add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("ids", "binary")


def _places(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.unique(table[:, 0])
        begins = np.searchsorted(table[:, 0], sizes)
        ends = np.append(begins[1:], len(table))
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.zeros(len(length), np.int64)
            for i in np.unique(np.searchsorted(sizes, length)):
                mine = length == sizes[i]
                at[mine] = begins[i] + np.searchsorted(table[begins[i] : ends[i], 1], rank[mine], "right") - 1
            found = table[at]
            keep = [i for i, n in enumerate(b.schema.names) if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    return run


@shielded
def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end: int = 2, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False, buckets: int = 512, bucket_rows: int = 4_096) -> DataFrame:
    """A row for each piece: the columns ``keep`` (all but the text if not given), piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian unsigned 32-bit) if asked for.

    A null or empty text is the end id alone. Repeated rows are packed each. Columns of these names are
    replaced; an empty table gives an empty one. The driver plans over at most ``capacity`` lengths; the
    ranks of a length are counted in up to ``buckets`` buckets, so that no task ranks a hot length alone.
    """
    new = [*PIECE.names, "sequence_id", "offset"]
    base, names, body = carried(docs, text_col, but_text(docs, text_col, keep), tuple(new))
    fields = PIECE.fields if with_ids else PIECE.fields[:-1]
    schema = T.StructType(fields_of(base, names) + fields)
    pieces = written(base.mapInArrow(_pieces(tokenizer, end, capacity, with_ids, len(names), body), schema), "pack-pieces")

    simple = [f.name for f in fields_of(base, names) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    total = pieces.count()
    n = max(1, min(buckets, total // bucket_rows))
    by = [F.xxhash64(*(F.col(f"`{c}`") for c in simple), "piece", "ids_crc32"), F.col("piece"), F.col("ids_crc32")]
    dealt = pieces.withColumn("__bucket", F.pmod(by[0], F.lit(n)).cast("int"))
    counted = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))  # at most capacity * buckets rows
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("length", "__bucket", before.alias("__before"))
    counts = {int(r.length): int(r.n) for r in counted.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*by)))
    ranked = ranked.join(F.broadcast(starts), ["length", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__r") - 1)
    ranked = ranked.select(*(F.col(f"`{f.name}`") for f in schema.fields), "__rank")
    return ranked.mapInArrow(_places(runs), T.StructType(schema.fields).add("sequence_id", "long").add("offset", "long"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
