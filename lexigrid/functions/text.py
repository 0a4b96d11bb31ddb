"""Text functions as Column expressions; all stay in the JVM.

R semantics are kept where they differ from Spark's: a missing value pastes as "NA", white space is not
collapsed by clean_text, and a split drops one trailing empty piece only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words removed from every text before corpus-specific ones are found.
SEED_WORDS = ("image", "images", "video", "videos", "findings", "finding", "send", "commonly", "common", "present", "demonstrate", "demonstrated", "likely", "best")

PHRASE = r"\b\w+_\w+\b"


def to_ascii(c: Column) -> Column:
    """Each non-ASCII character becomes as many spaces as it has UTF-8 bytes."""
    for span, n in ((r"[\x{80}-\x{7FF}]", 2), (r"[\x{800}-\x{FFFF}]", 3), (r"[\x{10000}-\x{10FFFF}]", 4)):
        c = F.regexp_replace(c, span, " " * n)
    return c


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def remove_words(c: Column, words: Sequence[str]) -> Column:
    """Whole plain ASCII words; one alternation, so their order makes no difference."""
    return F.regexp_replace(c, rf"\b({'|'.join(words)})\b", "") if words else c


def clean_text(c: Column, words: Sequence[str] = SEED_WORDS) -> Column:
    """ASCII, lower case, trimmed; other than letters, digits and spaces to a space; digits and the words dropped."""
    c = F.regexp_replace(trim_ws(F.lower(to_ascii(c))), "[^a-z0-9 ]", " ")
    return remove_words(F.regexp_replace(c, "[0-9]", ""), words)


def remove_punctuation(c: Column, keep_apostrophe: bool = False) -> Column:
    return F.regexp_replace(c, r"(?<![A-Za-z])'|'(?![A-Za-z])|[\p{Punct}&&[^']]" if keep_apostrophe else r"\p{Punct}", "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "")


def strip_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def title_case(c: Column) -> Column:
    return F.initcap(c)


def paste(*cols: Column, sep: str = " ") -> Column:
    """Joined with a separator; a missing value is the text NA."""
    return F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("NA")) for c in cols))


def split_r(c: Column, pattern: str) -> Column:
    """Split that drops one trailing empty piece; an empty text has no pieces."""
    parts = F.split(c, pattern)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def word_count(c: Column) -> Column:
    """Pieces between single /, _ or white space, inner empty ones included, a trailing empty one not."""
    return (F.length(F.regexp_replace(c, r"[^/_\s]", "")) + ((c != "") & ~c.rlike(r"[/_\s]$")).cast("int")).cast("long")


def remove_duplicate_words(c: Column) -> Column:
    return F.array_join(F.array_distinct(split_r(c, r"\s+")), " ")


def combine_phrases(c: Column, phrases: Sequence[str]) -> Column:
    """Each phrase in turn, literally, with its spaces as underscores; the order matters."""
    pairs = F.array(*(F.struct(F.lit(p).alias("a"), F.lit(p.replace(" ", "_")).alias("b")) for p in phrases)) if phrases else None
    return c if pairs is None else F.aggregate(pairs, c, lambda text, p: F.replace(text, p["a"], p["b"]))


def combine_keywords(c: Column, phrases: Sequence[str]) -> Column:
    """Pieces between / trimmed; those that are a phrase with their spaces as underscores."""
    known = F.array(*(F.lit(p) for p in phrases))
    one = lambda w: F.when(F.array_contains(known, trim_ws(w)), F.replace(trim_ws(w), F.lit(" "), F.lit("_"))).otherwise(trim_ws(w))
    return F.array_join(F.transform(split_r(c, "/"), one), "/")


def extract_phrases(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(PHRASE), F.lit(0)), "/")


def drop_phrases(c: Column) -> Column:
    return F.regexp_replace(c, PHRASE, "")


def tokens(c: Column) -> Column:
    """Words of a cleaned text."""
    return F.array_remove(F.split(c, " "), "")


def punctuated_tokens(c: Column) -> Column:
    """Words and single punctuation characters in order."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"), F.lit(0))


def padded_select(toks: Column, pattern: str) -> Column:
    """Tokens that match; the others leave an empty pad in their place."""
    return F.transform(toks, lambda t: F.when(t.rlike(pattern), t).otherwise(F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_value(a: Column, b: Column) -> Column:
    """Of two texts as sets of space-separated words."""
    words = lambda c: F.transform(split_r(c, " "), trim_ws)
    return jaccard(words(a), words(b))


def pair_key(a: Column, b: Column) -> Column:
    """For reports only; joins use the two ids."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def theme_of(*terms: Column) -> Column:
    """Terms joined by spaces; NA where all are missing."""
    joined = F.concat_ws(" ", *terms)
    return F.when(joined == "", "NA").otherwise(joined)


def replace_first(text: Column, old: str, new: str) -> Column:
    """The first occurrence of a literal replaced; the text itself where there is none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(text)
