"""Long lists of phrases joined in texts, in one pass a text.

Phrases are replaced one after the other, literally, each from the left without overlaps; a replacement only turns
spaces into underscores. So every occurrence of a phrase at its turn is one in the original text, none of whose spaces
was turned by an earlier phrase. An automaton of all phrases finds the occurrences in one pass, and they are then taken
in the order of the list. Two phrases that share no place of a text never meet, however long the list is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PhraseAutomaton:
    """The phrases of a list that have a space, by their places in it."""

    def __init__(self, phrases: Sequence[str]):
        import ahocorasick

        if any("_" in p and " " in p for p in phrases):
            raise ValueError("a phrase with an underscore could match what an earlier one has joined")
        places: dict[str, list[int]] = {}
        for i, p in enumerate(phrases):
            if " " in p:
                places.setdefault(p, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for p, at in places.items():
            self.automaton.add_word(p, (len(p), at))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def join(self, text: str) -> str:
        if not self.any or " " not in text:
            return text
        found = sorted((i, end - n + 1, end + 1) for end, (n, at) in self.automaton.iter(text) for i in at)
        turned, last, upto = set(), -1, 0
        for i, start, end in found:
            if i != last:
                last, upto = i, 0
            if start < upto:
                continue
            spaces = [k for k in range(start, end) if text[k] == " "]
            if turned.isdisjoint(spaces):
                turned.update(spaces)
                upto = end
        if not turned:
            return text
        out = list(text)
        for k in turned:
            out[k] = "_"
        return "".join(out)


def phrase_list(phrases: DataFrame, order: Sequence[str], most: int = 1_000_000) -> list[str]:
    """The phrases of (phrase, …) in the order of some columns, then by phrase; ends the job where there are more than ``most``, which each task would hold."""
    rows = phrases.select("phrase", *order).orderBy(*order, "phrase").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} phrases")
    return [r.phrase for r in rows]


def combine_listed(docs: DataFrame, text_col: str, phrases: Sequence[str], out_col: str = "joined", slice_rows: int = 64) -> DataFrame:
    """docs with the text in which each phrase of the list, in its order, has underscores for its spaces, as combine_phrases does for a short list.

    A null text stays null; empty texts and lists change nothing; phrases without a space change nothing; a column of that name is replaced. The list
    is broadcast; it must not hold a phrase with both a space and an underscore.
    """
    names = [c for c in docs.columns if c != out_col]
    base = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").alias("__text"))
    PhraseAutomaton([p for p in phrases if "_" in p][:1])  # says on the driver what is wrong
    sent = docs.sparkSession.sparkContext.broadcast(list(phrases))
    made: dict[str, PhraseAutomaton] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = made.setdefault("one", PhraseAutomaton(sent.value))
        for b in batches:
            for i in range(0, len(b), slice_rows):
                part = b.slice(i, slice_rows)
                texts = [None if t is None else automaton.join(t) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(names))), pa.array(texts, pa.string())], [*names, out_col])

    return base.mapInArrow(run, T.StructType([base.schema[c] for c in names]).add(out_col, "string"))
