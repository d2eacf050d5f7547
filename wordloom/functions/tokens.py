"""Words of a text as column expressions: chunks between white space, trimmed, or nothing where one is no word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word holds, what may be trimmed from its ends, where sentences end.
LETTERS = r"[\p{IsAlphabetic}']"
TRIMMABLE = r"[^\p{IsAlphabetic}'\p{N}\x{FFFD}]"
WORD = f"^{TRIMMABLE}*({LETTERS}+){TRIMMABLE}*$"
WHITE_SPACE = r"(?U)\s+"
LINE_END = r"\n"
SENTENCE_END = r"[.!?\n]"


def word_of(chunk: Column) -> Column:
    """The word in a chunk without white space; '' where a digit, a lost mark or anything else stands inside it."""
    return F.regexp_extract(chunk, WORD, 1)


def starts_upper(word: Column) -> Column:
    return word.rlike(r"^\p{IsUppercase}")


def pieces(text: Column, end: str = LINE_END) -> Column:
    """A text's lines, or its sentences with SENTENCE_END."""
    return F.split(text, end)


def words_of(piece: Column, cased: bool = False) -> Column:
    """A piece's words in order; '' where a chunk is no word, or with cased starts with a capital: it parts its neighbours."""
    chunks = F.filter(F.split(piece, WHITE_SPACE), lambda c: c != "")
    words = F.transform(chunks, word_of)
    return F.transform(words, lambda w: F.when(starts_upper(w), "").otherwise(w)) if cased else words


def adjacent(words: Column) -> Column:
    """(left, right) for neighbours that are both words."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.filter(pairs, lambda p: (p.left != "") & (p.right != ""))


def char_count(word: Column) -> Column:
    return F.char_length(word)


#: The character sets a lexicon may be held to. Kana words are tested by functions.kana.
CHARACTER_SETS = {"latin-lowercase": "^[a-z']*$", "hangul-syllables": "^[가-힣]*$"}


def accepts(word: Column, character_set: str | None) -> Column:
    """Whether every character of the word is of the set; None takes all."""
    if character_set is None:
        return F.lit(True)
    if character_set == "kana":
        from .kana import normalise

        return normalise(word).isNotNull()
    return word.rlike(CHARACTER_SETS[character_set])


def phrase_words(phrase: Column) -> Column:
    """A headword's spellings: its words, '^' and white space parting them, and with '^' and no white space also the words joined."""
    plain = F.regexp_replace(phrase, "[-ㆍ]", "")
    words = F.filter(F.split(F.translate(plain, "^", " "), WHITE_SPACE), lambda w: w != "")
    joined = F.replace(plain, F.lit("^"), F.lit(""))
    return F.when(F.contains(plain, F.lit("^")) & ~joined.rlike(WHITE_SPACE), F.array_union(words, F.array(joined))).otherwise(words)
