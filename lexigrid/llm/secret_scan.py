"""Secret scans by patterns and a linear-chain conditional random field.

Fixed patterns give the base spans. A random field over the words of a text tags each as begin, inside or
outside of a secret, from the shape of the word, of two words before and one after, and from what the whole
file looks like; Viterbi decoding finds the best tags. What it tags clear of the base spans is added. It is
trained on windows around the base spans of a bounded sample of texts and on windows without any, most of them
around words with digits. Patterns can only teach what they match already, so each window with a secret comes
in further forms: its cue and delimiters taken away or replaced, its value in other letters, shorter, or a random
key; and windows without one get harmless words of like length (addresses, dates, versions, numbers) in the
middle. So shape and neighbours have to carry what the patterns can't.

Decoding is exact but cheap: where a word's score for outside beats the others by more than twice the spread of
the transitions, the best path is outside there whatever stands beside it, so only the stretches between such
words are decoded.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, carried, fields_of, shielded, sliced, table, text_batches, utf8

# The base patterns, their kinds in order, and the least length of what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

WEAK_CUES = {b"key", b"keys", b"auth", b"pwd", b"pass", b"credential", b"credentials", b"bearer", b"authorization"}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(rb"[A-Za-z0-9+/_.=-]+")
RUNS = re.compile(rb"[a-z]+|[A-Z]+|[0-9]+")
CUE = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS, DIGITS = UPPER + UPPER.lower(), b"0123456789"
O, B, I = 0, 1, 2  # noqa: E741

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str, words: list[bytes], data: bytes | None = None) -> list[Span]:
    """Spans of the base patterns by start, then kind; a match that is too short is dropped.

    No pattern but the first crosses white space, so the words tell whether a text can hold a match at all.
    """
    out: list[Span] = []
    low = (utf8(text) if data is None else data).lower()
    if any(c in low for c in CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if max(map(len, words), default=0) >= LEAST_HEX:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def length_class(n: int) -> str:
    return "n:" + ("0" if n < 4 else "4" if n < 8 else "8" if n < 16 else "16" if n < 32 else "32")


#: Of words of ASCII letters alone, by their length up to 32.
PLAIN = tuple(("any", length_class(n), "letters") for n in range(33))


def attributes(word: bytes) -> tuple[str, ...]:
    """The shape of a word."""
    if word.isalpha() and not CUE.search(word) and word.lower() not in WEAK_CUES:
        return PLAIN[min(len(word), 32)]
    low = word.lower()
    core = max(CORE.findall(word), key=len, default=b"")
    n = len(core)
    digit, letter = len(core.translate(None, DIGITS)) < n, len(core.translate(None, LETTERS)) < n
    upper = len(core[1:].translate(None, UPPER)) < n - 1
    out = ["any", length_class(n)]
    out.append("mixed" if digit and letter else "digits" if digit else "letters" if letter else "other")
    if digit and n >= 16 and not core.translate(None, b"0123456789abcdefABCDEF"):
        out.append("hex")
    if upper and digit:
        out.append("upper")
    if CUE.search(word):
        out.append("cue")
    elif low.strip(b"\"'`:=,;()[]{}<>") in WEAK_CUES:
        out.append("weak cue")
    if low.strip(b":=") == b"" or low.endswith((b"=", b":")):
        out.append("sets")
    if word[:1] in (b'"', b"'", b"`"):
        out.append("quoted")
    runs = len(RUNS.findall(core)) if n >= 12 else 0
    if runs >= 5:
        out.append("jumbled" if 5 * runs >= 2 * n else "runs")
    if b"@" in word:
        out.append("at")
    if b"://" in word or low.startswith(b"www."):
        out.append("url")
    if len(core.translate(None, b"./-_")) < n - 1:
        out.append("parted")
    return tuple(out)


#: Every attribute, in a fixed order.
NAMES = ("any", "n:0", "n:4", "n:8", "n:16", "n:32", "mixed", "digits", "letters", "other", "hex", "upper", "cue", "weak cue", "sets", "quoted", "runs", "jumbled", "at", "url", "parted")
AT = {a: i for i, a in enumerate(NAMES)}
PLACES = (0, -1, -2, 1)  # the word itself, one and two before, one after
FILES = 4


@dataclass
class Shapes:
    """Numbers for words by their attributes; number 0 is for no word."""

    of: dict[tuple[str, ...], int] = field(default_factory=lambda: {(): 0})
    memo: dict[bytes, int] = field(default_factory=dict)

    def ids(self, words: list[bytes], most: int = 300_000) -> np.ndarray:
        if len(self.memo) > most:
            self.memo.clear()
        memo = self.memo
        for w in set(words):
            if w not in memo:
                memo[w] = self.of.setdefault(attributes(w), len(self.of))
        return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))

    def matrix(self) -> np.ndarray:
        m = np.zeros((len(self.of), len(NAMES)))
        for shape, k in self.of.items():
            m[k, [AT[a] for a in shape]] = 1
        return m


def file_marks(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shapes have a cue, and which digits."""
    return matrix[:, AT["cue"]] > 0, matrix[:, AT["mixed"]] + matrix[:, AT["digits"]] > 0


def file_class(ids: np.ndarray, marks: tuple[np.ndarray, np.ndarray]) -> int:
    """What the whole text looks like: whether it has a cue, and whether over 2 % of its words hold digits."""
    if not len(ids):
        return 0
    cue, digit = marks
    return 2 * bool(cue[ids].any()) + bool(np.count_nonzero(digit[ids]) > 0.02 * len(ids))


@dataclass
class Field:
    """Weights: of (place, attribute, tag), (file class, tag), (tag before, tag); the tag before the first word is outside."""

    shape: np.ndarray = field(default_factory=lambda: np.zeros((len(PLACES), len(NAMES), 3)))
    file: np.ndarray = field(default_factory=lambda: np.zeros((FILES, 3)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def scores(self, ids: np.ndarray, file: int, by_shape: list[np.ndarray]) -> np.ndarray:
        """Of each word and tag. by_shape: for each place, shapes x tags."""
        out = by_shape[0][ids] + self.file[file]
        for place, rows in zip(PLACES[1:], by_shape[1:], strict=True):
            if place < 0:
                out[-place:] += rows[ids[:place]]
            else:
                out[:-place] += rows[ids[place:]]
        return out

    def by_shape(self, matrix: np.ndarray) -> list[np.ndarray]:
        return [matrix @ w for w in self.shape]


def viterbi(scores: np.ndarray, moves: np.ndarray, last_outside: bool) -> list[int]:
    """Best tags of a stretch that follows a word outside, and is followed by one if last_outside."""
    best, back = moves[O] + scores[0], []
    for s in scores[1:]:
        step = best[:, None] + moves
        back.append(step.argmax(0))
        best = step.max(0) + s
    tag = int((best + moves[:, O] * last_outside).argmax())
    tags = [tag]
    for row in reversed(back):
        tag = int(row[tag])
        tags.append(tag)
    return tags[::-1]


def decode(scores: np.ndarray, moves: np.ndarray) -> dict[int, int]:
    """Tags of the words that are not outside."""
    spread = moves[moves > -1e8].max() - moves[moves > -1e8].min() if moves.size else 0
    sure = scores[:, O] - scores[:, 1:].max(1) > 2 * spread
    open_ = np.flatnonzero(~sure)
    out: dict[int, int] = {}
    if len(open_):
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            a, b = int(part[0]), int(part[-1]) + 1
            out |= {a + i: t for i, t in enumerate(viterbi(scores[a:b], moves, b < len(scores))) if t}
    return out


def gradient(model: Field, matrix: np.ndarray, at: list[np.ndarray], tags: np.ndarray, files: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Minus the log likelihood of padded sequences and its gradient by model.shape, model.file and model.moves. A sequence ends where its shapes are 0: what pads it takes no part."""
    n, length = tags.shape
    real = at[0] > 0
    onehot = np.eye(3)[tags] * real[..., None]
    e = (sum(b[i] for b, i in zip(model.by_shape(matrix), at, strict=True)) + model.file[files][:, None, :]) * real[..., None]
    move = model.moves
    alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
    alpha[:, 0] = e[:, 0] + move[O]
    for t in range(1, length):
        x = alpha[:, t - 1, :, None] + move
        top = x.max(1)
        alpha[:, t] = np.where(real[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + e[:, t], alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        x = move + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
        top = x.max(2)
        beta[:, t] = np.where(real[:, t + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), 0.0)
    z = alpha[:, -1].max(1)
    z = z + np.log(np.exp(alpha[:, -1] - z[:, None]).sum(1))
    marginal = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
    pair = np.exp(np.where(real[:, 1:, None, None], alpha[:, :-1, :, None] + move + (e + beta)[:, 1:, None, :] - z[:, None, None, None], -np.inf))
    before = np.concatenate([np.zeros((n, 1), int), tags[:, :-1]], 1)
    moved = np.zeros((3, 3))
    np.add.at(moved, (before.ravel(), tags.ravel()), real.ravel().astype(float))
    expected = pair.sum((0, 1))
    expected[O] += marginal[:, 0].sum(0)
    miss = marginal - onehot
    by_shape, by_file = np.zeros_like(model.shape), np.zeros_like(model.file)
    for k, i in enumerate(at):
        by_shape[k] = matrix.T @ np.stack([np.bincount(i.ravel(), miss[..., y].ravel(), len(matrix)) for y in range(3)], 1)
    np.add.at(by_file, files, miss.sum(1))
    held = float((e * onehot).sum() + (np.where(moved > 0, move, 0.0) * moved).sum())
    return float(z.sum()) - held, [by_shape, by_file, expected - moved]


def train(sequences: list[tuple[np.ndarray, np.ndarray, int]], matrix: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 3e-4) -> Field:
    """Maximum likelihood with a square penalty, by Adam; sequences of (shapes with two before and one after, tags, file class), padded with zeros to one length."""
    model = Field()
    if not sequences:
        model.file[:, O] = 10.0
        return model
    ids, tags, files = (np.array([s[i] for s in sequences]) for i in range(3))
    n, length = tags.shape
    at = [ids[:, 2 + p : 2 + p + length] for p in PLACES]
    theta = [model.shape, model.file, model.moves]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, rounds + 1):
        _, g = gradient(model, matrix, at, tags, files)
        for j, x in enumerate(theta):
            grad = g[j] / n + decay * x
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.999 * v[j] + 0.001 * grad**2
            x -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return model


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = [m.span() for m in WORD.finditer(text)]
    return np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64)


def _windows(length: int, per_text: int):
    """Training windows of a text as JSON-free rows: the words, their tags, and the file's word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in sliced(batches, "text"):
            out_words, out_tags, out_file, out_base = [], [], [], []
            for text in b.column("text").to_pylist():
                words = utf8(text).split()
                if not words:
                    continue
                spans = base_spans(text, words)
                starts, ends = word_places(text)
                tags = np.zeros(len(words), np.int32)
                for a, _, z in spans:
                    i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, z, "left"))
                    if not tags[i:j].any():
                        tags[i:j] = I
                        tags[i] = B
                kind = file_class(shapes.ids(words), file_marks(shapes.matrix()))
                middle = sorted({int(np.searchsorted(ends, a, "right")) for a, _, _ in spans})[:per_text]
                if not middle:  # the longest word with a digit, and the middle
                    middle = sorted({max((k for k, w in enumerate(words) if len(w.translate(None, DIGITS)) < len(w)), key=lambda k: len(words[k]), default=0), len(words) // 2})
                for c in middle:
                    lo = max(0, c - length // 2)
                    part = words[max(0, lo - 2) : lo + length + 1]
                    out_words.append([b""] * (2 - min(2, lo)) + part)
                    out_tags.append(tags[lo : lo + length].tolist())
                    out_file.append(kind)
                    out_base.append(bool(spans))
            yield pa.RecordBatch.from_arrays([pa.array(out_words, pa.list_(pa.binary())), pa.array(out_tags, pa.list_(pa.int32())), pa.array(out_file, pa.int32()), pa.array(out_base, pa.bool_())], ["words", "tags", "file", "base"])

    return run


#: Words that look odd and are no secrets.
HARMLESS = (
    "2024-01-15T10:32:00Z", "2023/11/05", "12:45:09", "v2.13.1", "1.0.0-beta.4", "https://example.org/a/b?id=4711", "http://localhost:8080/index.html",
    "www.example.com/page2", "src/main/java8/File2.java", "10.0.0.1:8080", "192.168.100.254", "COVID-19", "ISO-8859-1", "sha256", "utf8", "mp3",
    "978-3-16-148410-0", "doi:10.1000/182", "user.name42@mail7.example.com", "jane_doe+news@example.org", "4041894974608795", "+49-170-1234567",
    "(555)", "555-0199", "$1,234.56", "1234567890", "20240115103200", "fe80::1ff:fe23:4567:890a", "3.5GHz", "HttpServer2RequestHandler3", "IMG_20240115_103200.jpg", "Q3/2024", "x86_64-linux-gnu",
)
BASE62 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def secret_value(words: list[bytes]) -> bytes:
    """The value in the words of a base span: the longest stretch of its last word, behind what sets it."""
    return max(CORE.findall(re.split(rb"[:=]", words[-1].rstrip(b"="))[-1]), key=len, default=b"")


def disguised(value: bytes, rng: random.Random) -> bytes:
    """Another form of a value that no base pattern need match."""
    how = rng.randrange(5)
    if how == 0:
        return value
    if how == 1:
        return value.upper()
    if how == 2:
        return bytes(c ^ 32 if 65 <= c & ~32 <= 90 and rng.random() < 0.5 else c for c in value)
    if how == 3:
        return value[: rng.randint(16, 30)]
    return bytes(rng.choice(BASE62) for _ in range(rng.randint(18, 44)))


def further_forms(words: list[bytes], tags: list[int], file: int, length: int, rng: random.Random) -> list[tuple[list[bytes], list[int], int]]:
    """Of a window (two words, then those of tags, then one): two with its secrets disguised, or without a secret two with a harmless word, once as the first of its text."""
    out = []
    if B not in tags:
        k = 2 + len(tags) // 2
        inside = ([*words[:k], rng.choice(HARMLESS).encode(), *words[k + 1 :]], tags, file)
        first = ([b"", b"", rng.choice(HARMLESS).encode(), *words[k + 1 :]], [O] * (len(words) - k - 1), file)
        return [inside, first]
    for _ in range(2):
        new, marks, k = list(words[:2]), [], 0
        while k < len(tags):
            end = k + 1
            if tags[k] == B:
                while end < len(tags) and tags[end] == I:
                    end += 1
                value = disguised(secret_value(words[2 + k : 2 + end]), rng)
                if len(value) < 12:
                    value = bytes(rng.choice(BASE62) for _ in range(rng.randint(18, 44)))
                before = rng.choice(([], [], [b"bearer"], [b"Authorization:", b"Bearer"], [b"key"], [b"key:"], [b"auth"], [b"credentials"]))
                quote = rng.choice((b"", b"", b'"', b"'"))
                new += [*before, quote + value + quote]
                marks += [*[O] * len(before), B]
            else:
                new.append(words[2 + k])
                marks.append(O)
            k = end
        new += words[2 + len(tags) :]
        out.append((new[: 3 + length], marks[:length], file & 1))
    return out


def fit_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_texts: int = 6_000, max_windows: int = 1_500, length: int = 12) -> tuple[Field, Shapes]:
    """Trains on windows of at most max_texts texts (the first by a hash of the id): up to max_windows with base spans, as many without, and further forms of each."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = rows.select("id").filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_texts)
    sample = rows.join(F.broadcast(ids), "id").select("text")
    scratch = Scratch(docs.sparkSession, "secrets")
    windows = scratch.written(sample.mapInArrow(_windows(length, 3), "words array<binary>, tags array<int>, file int, base boolean"), "windows")
    key = F.xxhash64(F.to_json(F.struct("words", "tags")))
    picked = [windows.filter(F.col("base") == base).orderBy(key).limit(max_windows).collect() for base in (True, False)]
    scratch.clear()
    rows = sorted(([bytes(w) for w in r.words], list(r.tags), r.file) for p in picked for r in p)
    rng = random.Random(0)
    rows += [x for row in rows for x in further_forms(*row, length, rng)]
    shapes, raw = Shapes(), []
    for words, tags, file in rows:
        ids_ = shapes.ids([w for w in words if w])
        ids_ = np.concatenate([np.zeros(len(words) - len(ids_), np.int32), ids_])
        raw.append((np.pad(ids_, (0, length + 3 - len(ids_))), np.pad(np.array(tags, np.int32), (0, length - len(tags))), file))
    return train(raw, shapes.matrix()), shapes


def scanner(model: Field, shapes: Shapes):
    """A function from a text to its spans, base and added, by start and kind."""
    own = Shapes(dict(shapes.of))
    state: dict = {"n": -1}

    def scan(text: str | None) -> list[Span]:
        data = utf8(text)
        words = data.split()
        if not words:
            return []
        spans = base_spans(text, words, data)
        ids = own.ids(words)
        if state["n"] != len(own.of):
            state["n"], state["matrix"] = len(own.of), own.matrix()
            state["by"], state["marks"] = model.by_shape(state["matrix"]), file_marks(state["matrix"])
        tagged = decode(model.scores(ids, file_class(ids, state["marks"]), state["by"]), model.moves)
        if not tagged:
            return spans
        starts, ends = word_places(text)
        added, order = [], sorted(tagged)
        for k in order:
            if tagged[k] == I and added and added[-1][1] == k:
                added[-1][1] = k + 1
            else:
                added.append([k, k + 1])
        for i, j in added:
            a, z = int(starts[i]), int(ends[j - 1])
            body = text[a:z]
            a += len(body) - len(body.lstrip("\"'`([{<"))
            z -= len(body) - len(body.rstrip("\"'`)]}>,;.#*$%&!?"))
            if a < z and not any(a < e and s < z for s, _, e in spans if _ < 3):
                spans.append((a, 3, z))
        return sorted(spans)

    return scan


@shielded
def secret_scan(docs: DataFrame, model: tuple[Field, Shapes], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all columns, the text too, if not given) with secrets: array of (kind, start, end) in code points, end exclusive.

    A null or empty text has none; repeated rows get the same; a column named secrets is replaced.
    """
    base, names, body = carried(docs, text_col, keep if keep is not None else docs.columns, ("secrets",))
    kind = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(*model)
        for b in sliced(batches, body):
            found = [[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in scan(t)] for t in b.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(found, arrow)], [*names, "secrets"])

    return base.mapInArrow(run, T.StructType(fields_of(base, names)).add("secrets", kind))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan(docs, fit_secrets(docs), keep=["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = listed(F.filter("secrets", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, _, z in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: tuple[Field, Shapes], text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with every secret of its text replaced by the mark; a null text stays null, and all other columns as they are."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(*model)
        for b in sliced(batches, text_col):
            texts = [t if t is None else redacted(t, scan(t), mark) for t in b.column(text_col).to_pylist()]
            i = b.schema.names.index(text_col)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == i else b.column(k) for k in range(b.num_columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
