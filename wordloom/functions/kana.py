"""Kana as column expressions: one script for keys, katakana for showing, the cycle of forms, and romaji."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Half-width forms in their code's order and what they stand for; plain, voiced and half-voiced kana.
HALF = "".join(map(chr, range(0xFF61, 0xFFA0)))
FULL = "。「」、・をぁぃぅぇぉゃゅょっーあいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわん゛゜"
PLAIN, VOICED = "かきくけこさしすせそたちつてとはひふへほうゝ", "がぎぐげござじずぜぞだぢづでどばびぶべぼゔゞ"
PLAIN_H, HALF_VOICED = "はひふへほ", "ぱぴぷぺぽ"
SMALL_OF = {"あ": "ぁ", "い": "ぃ", "う": "ぅ", "え": "ぇ", "お": "ぉ", "つ": "っ", "や": "ゃ", "ゆ": "ゅ", "よ": "ょ", "わ": "ゎ"}
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))


def normalise(text: Column) -> Column:
    """The text in hiragana, detached marks merged into the kana before them; NULL where anything else is left."""
    one = F.translate(F.translate(text, HALF, FULL), KATAKANA + "゙゚", HIRAGANA + "゛゜")
    pairs = [(a + "゛", b) for a, b in zip(PLAIN, VOICED)] + [(a + "゜", b) for a, b in zip(PLAIN_H, HALF_VOICED)]
    merged = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, one)
    return F.when(merged.rlike("^[ぁ-ゖーゝゞ]*$"), merged)


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def _cycles() -> dict[str, str]:
    voiced, half = dict(zip(PLAIN, VOICED)), dict(zip(PLAIN_H, HALF_VOICED))
    out = {}
    for plain in dict.fromkeys([*SMALL_OF, *PLAIN[:-1]]):
        ring = [plain, *filter(None, (SMALL_OF.get(plain), voiced.get(plain), half.get(plain)))]
        out |= dict(zip(ring, [*ring[1:], ring[0]]))
    return out


def next_form(character: Column) -> Column:
    """The next of a kana's forms (plain, small, voiced, half-voiced); NULL where it has one only."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(_cycles().items()))), character)


@lru_cache(1)
def romaji_table() -> dict[str, str]:
    """Syllables by rule: a consonant's row, its glides, and spellings of their own."""
    # Rows of five vowels by consonant; a row's kana before small ya, i, yu, e, yo; other spellings.
    vowels = "aiueo"
    rows = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ", "x": "ぁぃぅぇぉ", "l": "ぁぃぅぇぉ"}
    glides = {"ky": "き", "gy": "ぎ", "sy": "し", "jy": "じ", "zy": "じ", "cy": "ち", "ty": "ち", "dy": "ぢ", "ny": "に", "hy": "ひ", "by": "び", "py": "ぴ", "my": "み", "ry": "り", "th": "て", "dh": "で"}
    small_vowels = {"tw": "と", "dw": "ど", "ts": "つ", "q": "く", "f": "ふ", "v": "ゔ", "wh": "う"}
    own = {
        "shi": "し", "sha": "しゃ", "shu": "しゅ", "she": "しぇ", "sho": "しょ", "ji": "じ", "ja": "じゃ", "ju": "じゅ", "je": "じぇ", "jo": "じょ", "chi": "ち",
        "cha": "ちゃ", "chu": "ちゅ", "che": "ちぇ", "cho": "ちょ", "ca": "か", "ci": "し", "cu": "く", "ce": "せ", "co": "こ", "kwa": "くぁ", "gwa": "ぐぁ",
        "swa": "すぁ", "tsu": "つ", "fu": "ふ", "qu": "く", "vu": "ゔ", "whu": "う", "fya": "ふゃ", "fyu": "ふゅ", "fyo": "ふょ", "vya": "ゔゃ", "vyu": "ゔゅ",
        "vyo": "ゔょ", "yi": "い", "ye": "いぇ", "wu": "う", "ya": "や", "yu": "ゆ", "yo": "よ", "wa": "わ", "wi": "うぃ", "we": "うぇ", "wo": "を", "nn": "ん",
        "n'": "ん", "xn": "ん", "xtu": "っ", "xtsu": "っ", "ltu": "っ", "ltsu": "っ", "xwa": "ゎ", "lwa": "ゎ", "xya": "ゃ", "xyu": "ゅ", "xyo": "ょ",
        "lya": "ゃ", "lyu": "ゅ", "lyo": "ょ", "-": "ー", ".": "。", ",": "、", "/": "・", "[": "「", "]": "」",
    }
    table = {c + v: k for c, row in rows.items() for v, k in zip(vowels, row)}
    table |= {c + v: k + s for c, k in glides.items() for v, s in zip(vowels, "ゃぃゅぇょ")}
    table |= {c + v: k + s for c, k in small_vowels.items() for v, s in zip(vowels, "ぁぃぅぇぉ")}
    return table | own


@lru_cache(1)
def _romaji_pattern() -> re.Pattern:
    known = "|".join(map(re.escape, sorted(romaji_table(), key=len, reverse=True)))
    # A doubled consonant (or t before c) is a small tsu; an n before what cannot go on from it stands for itself.
    return re.compile(rf"({known})|([b-df-hj-mp-tv-z])(?=\2)|(t)(?=c)|(n)(?![aiueoyn'])|(.)", re.S)


def kana_of(roman: str | None) -> str | None:
    if roman is None:
        return None
    return _romaji_pattern().sub(lambda m: romaji_table()[m[1]] if m[1] else "っ" if m[2] or m[3] else "ん" if m[4] else m[5], roman.lower())


@F.pandas_udf(T.StringType())
def romaji_to_kana(roman: pd.Series) -> pd.Series:
    """Kana of romaji, the longest syllable first; a lone n at the end is ん, other letters stay."""
    return roman.map(kana_of, na_action="ignore")
