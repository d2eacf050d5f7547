"""Keys of words by a language's encoding: as they are, on the two-set Hangul keyboard, or in one kana script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hangul, kana, typing

ENCODINGS = ("utf8", "hangul", "kana")


def _known(encoding: str) -> str:
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}: one of {ENCODINGS}")
    return encoding


def encode(word: Column, encoding: str) -> Column:
    """A word's key; NULL where the encoding has none for it."""
    return {"utf8": lambda: word, "hangul": lambda: hangul.encode(word), "kana": lambda: kana.normalise(word)}[_known(encoding)]()


def decode(key: Column, encoding: str) -> Column:
    """The word that a key shows as."""
    return hangul.decode(key) if _known(encoding) == "hangul" else key


def key_byte(character: Column, encoding: str) -> Column:
    """A typed character's key where it takes one byte, else NULL; only utf8 folds case."""
    return typing.key_byte(encode(typing.fold(character) if encoding == "utf8" else character, encoding))
