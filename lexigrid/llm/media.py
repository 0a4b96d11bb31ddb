"""Media columns with content-defined chunks.

A text's bytes, padded, become the samples of an 8-bit mono WAV file. Its samples are cut where a rolling
gear hash says so, so that equal stretches are cut alike wherever they lie. Chunks are known by their SHA-256:
a join elects one owner for each digest, only the owner's container keeps the bytes, and every document keeps
its ordered list of digests. Reading back puts each file together from its own chunks and those that others
own, checks every digest, and computes the features from what was read.

A chunk that makes up a large part of all rows would be one hot key of the joins by digest. There are less than
OFTEN chunks with more than a share of 1 / OFTEN of all rows, of at most 16 KB each: these meet their rows
by broadcast, and only the others by a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shielded, sliced, table, text_batches, utf8

RATE = 8_000
HEADER = 44
#: Chunks with a larger share of all rows than 1 / OFTEN are joined by broadcast: fewer than OFTEN of them, 16 MB at most.
OFTEN = 1_000


@lru_cache(1)
def gear() -> np.ndarray:
    """A pseudo-random 32-bit number for each byte."""
    return np.frombuffer(b"".join(hashlib.md5(bytes([i])).digest()[:4] for i in range(256)), "<u4")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(the bytes padded with 0 to a positive multiple of 64, their number before)."""
    data = utf8(text)
    return data + b"\0" * (-len(data) % 64 or 64 * (not data)), len(data)


def wav_header(n: int) -> bytes:
    """Of n 8-bit mono samples. The sizes of a file over 4 GB, which the format can't say, are written as its largest number."""
    top = 2**32 - 1
    return b"RIFF" + struct.pack("<I", min(top, 36 + n)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", min(top, n))


def cuts(data: bytes, least: int = 1_024, bits: int = 12, most: int = 16_384) -> list[int]:
    """Ends of the chunks: after a byte where the top ``bits`` bits of the gear hash of the last 32 bytes are 0, least to most bytes from the cut before."""
    h = gear()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum of gear << age over the last 32 bytes, by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # the right side is whole before it is stored
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    ends, at = [], 0
    while True:
        i = int(np.searchsorted(marks, at + least))
        end = min(int(marks[i]) if i < len(marks) else len(data), at + most)
        if end >= len(data):
            return [*ends, len(data)]
        ends.append(end)
        at = end


def chunks_of(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def features(samples: bytes) -> str:
    """Of 8-bit samples, centred at 128: number, seconds, mean, root mean square, sign changes and a 4-bin histogram."""
    x = np.frombuffer(samples, np.uint8)
    y = x.astype(np.int16) - 128
    rms = float(np.sqrt(np.mean(np.square(y, dtype=np.float64))))
    bins = np.bincount(x >> 6, minlength=4)
    return f"n={len(x)};s={len(x) / RATE:.4f};mean={x.mean():.6f};rms={rms:.6f};zc={int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))};hist={'/'.join(map(str, bins))}"


MANIFEST = "uid string, seq int, digest binary"


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "__text"):
        uid, seq, digest = [], [], []
        for u, text in zip(b.column("uid").to_pylist(), b.column("__text").to_pylist(), strict=True):
            for k, c in enumerate(chunks_of(payload_of(text)[0])):
                uid.append(u)
                seq.append(k)
                digest.append(hashlib.sha256(c).digest())
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.string()), pa.array(seq, pa.int32()), pa.array(digest, pa.binary())], ["uid", "seq", "digest"])


CONTAINER = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary()), ("shared", pa.bool_()), ("often", pa.bool_())]))
CHUNKS = "chunks array<struct<digest: binary, bytes: binary, shared: boolean, often: boolean>>"


def _contain(names: list[str]):
    """Rows (…, uid, __text, __foreign, __lent, __often) to containers: no bytes for the foreign chunks, a mark on the lent ones and on those of many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__text"):
            n_bytes, head, lists = [], [], []
            for text, *marks in zip(*(b.column(c).to_pylist() for c in ("__text", "__foreign", "__lent", "__often")), strict=True):
                payload, n = payload_of(text)
                not_own, shared, often = (set(m or ()) for m in marks)
                lists.append([{"digest": hashlib.sha256(c).digest(), "bytes": None if k in not_own else c, "shared": k in shared, "often": k in often} for k, c in enumerate(chunks_of(payload))])
                n_bytes.append(n)
                head.append(wav_header(len(payload)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*names, "uid"]), pa.array(n_bytes, pa.int64()), pa.array(head, pa.binary()), pa.array(lists, CONTAINER)], [*names, "uid", "n_bytes", "header", "chunks"])

    return run


def _read(names: list[str]):
    """Puts each file together, checks it and describes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            borrowed = b.column("borrowed").to_pylist() if "borrowed" in b.schema.names else [None] * len(b)
            for n, head, chunks, others in zip(b.column("n_bytes").to_pylist(), b.column("header").to_pylist(), b.column("chunks").to_pylist(), borrowed, strict=True):
                by = {o["seq"]: o["bytes"] for o in others or ()}
                if any(c["bytes"] is None and by.get(k) is None for k, c in enumerate(chunks)):
                    raise ValueError("a chunk is in none of the containers that are read")
                parts = [c["bytes"] if c["bytes"] is not None else by[k] for k, c in enumerate(chunks)]
                if any(hashlib.sha256(p).digest() != c["digest"] for p, c in zip(parts, chunks, strict=True)):
                    raise ValueError("a stored chunk does not match its digest")
                media = b"".join([head, *parts])
                samples = media[HEADER:]
                if media[:HEADER] != wav_header(len(samples)):
                    raise ValueError("a stored header does not match its samples")
                out.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [*names, *RESULT])

    return run


RESULT = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
RESULT_KINDS = ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def store(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, broadcast_bytes: int = 32_000_000, often: int = OFTEN) -> DataFrame:
    """Writes docs as containers under path and gives them: the columns ``keep`` (all but the text if not given), uid, n_bytes, header, chunks.

    A null text is an empty one. uid tells rows apart by their doc_id and text; equal rows have equal
    containers. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    text_batches(spark)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("uid", "header", "chunks", text_col, *RESULT)]
    ident = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit("")
    uid = F.concat_ws(":", F.coalesce(ident, F.lit("null")), F.hex(F.xxhash64(text_col)), F.coalesce(F.octet_length(text_col), F.lit(-1)))
    base = docs.select(*(F.col(f"`{c}`") for c in names), uid.alias("uid"), F.col(text_col).alias("__text"))
    base.select("uid", "__text").mapInArrow(_manifest, MANIFEST).write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    # Only digests that occur twice need an owner: elsewhere a chunk is its document's own.
    manifest.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "seq")).alias("owner")).filter("n > 1").write.parquet(f"{path}/owners")
    owners = spark.read.parquet(f"{path}/owners").withColumn("often", F.col("n") * F.lit(often) > F.lit(manifest.count()))
    few = F.broadcast(owners.filter("often"))
    rest = manifest.join(few.select("digest"), "digest", "left_anti").join(owners.filter("not often"), "digest")
    refs = manifest.join(few, "digest").unionByName(rest).select("uid", "seq", "often", (F.struct("uid", "seq") == F.col("owner")).alias("own"))
    marked = {"__foreign": ~F.col("own"), "__lent": F.col("own"), "__often": F.col("often")}
    refs = refs.groupBy("uid").agg(*(F.collect_set(F.when(c, F.col("seq"))).alias(k) for k, c in marked.items()))
    refs.write.parquet(f"{path}/shared")
    refs = spark.read.parquet(f"{path}/shared")
    held = refs.agg(F.sum(64 + F.octet_length("uid") + 4 * (F.size("__foreign") + F.size("__lent") + F.size("__often")))).first()[0] or 0
    rows = base.join(F.broadcast(refs) if held <= broadcast_bytes else refs, "uid", "left")
    rows = rows.select(*(F.col(f"`{c}`") for c in names), "uid", "__text", *marked)
    rows.mapInArrow(_contain(names), f"{_ddl(base, [*names, 'uid'])}, n_bytes long, header binary, {CHUNKS}").write.option("compression", "zstd").parquet(f"{path}/containers")
    return spark.read.parquet(f"{path}/containers")


def read_media(containers: DataFrame) -> DataFrame:
    """The kept columns with what reading each file back gives (RESULT), of the containers of one store(). A container whose lender is not among them ends the job with a ValueError."""
    names = [c for c in containers.columns if c not in ("uid", "n_bytes", "header", "chunks")]
    kinds = f"{_ddl(containers, names)}{RESULT_KINDS}" if names else RESULT_KINDS[2:]
    whole = ~F.exists("chunks", lambda c: c["bytes"].isNull())
    alone = containers.filter(whole).mapInArrow(_read(names), kinds)
    lacking = containers.filter(~whole)
    wanted = lacking.select("uid", F.posexplode("chunks").alias("seq", "c")).filter("c.bytes is null").select("uid", "seq", F.col("c.digest").alias("digest"), F.col("c.often").alias("often")).distinct()

    def found(often: bool) -> DataFrame:
        those = F.filter("chunks", lambda c: c["shared"] & (c["often"] == F.lit(often)))
        lent = containers.select(F.explode(those).alias("c")).groupBy(F.col("c.digest").alias("digest")).agg(F.first("c.bytes").alias("bytes"))
        return wanted.filter(F.col("often") == F.lit(often)).join(F.broadcast(lent) if often else lent, "digest").select("uid", "seq", "bytes")

    borrowed = found(True).unionByName(found(False)).groupBy("uid").agg(F.collect_list(F.struct("seq", "bytes")).alias("borrowed"))
    rest = lacking.join(borrowed, "uid", "left").mapInArrow(_read(names), kinds)
    return alone.unionByName(rest)


@shielded
def media(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Stores docs (in the shared folder if no path is given) and reads them back; an empty table gives an empty one."""
    import uuid

    path = path or f"{shared_dir(docs.sparkSession)}/lexigrid/media-{uuid.uuid4().hex}"
    return read_media(store(docs, path, text_col, keep))


def op10_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media(docs).select("doc_id", *RESULT)
