"""SQL fragments for the oracles."""

from __future__ import annotations

from ..functions.text import SEED_WORDS

WS = r"chr(32) || chr(9) || chr(13) || chr(10)"


def clean(c: str, words: tuple[str, ...] = SEED_WORDS) -> str:
    for span, n in ((r"[\x{80}-\x{7FF}]", 2), (r"[\x{800}-\x{FFFF}]", 3), (r"[\x{10000}-\x{10FFFF}]", 4)):
        c = f"regexp_replace({c}, '{span}', '{' ' * n}', 'g')"
    c = f"regexp_replace(trim(lower({c}), {WS}), '[^a-z0-9 ]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({c}, '[0-9]', '', 'g'), '\b({'|'.join(words)})\b', '', 'g')"


def tokens(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """A query of (doc, term), a row a token."""
    return f"SELECT doc, term FROM (SELECT {key} AS doc, unnest(string_split({clean(text)}, ' ')) AS term FROM {source}) WHERE term <> ''"


def values(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + ")"
