"""Letters with their places: syllables composed of them, and taken apart."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from wordloom.functions import hangul


def test_all_syllables_go_through_their_placed_letters(spark):
    every = spark.range(0xAC00, 0xAC00 + 11_172).select(F.decode(F.unhex(F.hex("id")), "UTF-16BE").alias("s"))
    rows = every.select("s", hangul.conjoin(F.col("s")).alias("parts"), hangul.compose(hangul.conjoin(F.col("s"))).alias("back"), hangul.compose(hangul.decompose(F.col("s"))).alias("typed"), hangul.encode(hangul.conjoin(F.col("s"))).alias("key"), hangul.encode(F.col("s")).alias("same")).collect()
    assert len(rows) == 11_172
    for r in rows:
        assert r["parts"] == unicodedata.normalize("NFD", r["s"]) and r["back"] == r["s"] == r["typed"] and r["key"] == r["same"]


def test_words_of_placed_and_other_letters(spark):
    nfd = lambda word: unicodedata.normalize("NFD", word)
    first, vowel, last = (lambda c, start=start, of=of: chr(start + of.index(c)) for start, of in ((0x1100, hangul.INITIALS), (0x1161, hangul.MEDIALS), (0x11A8, hangul.FINALS)))
    want = {
        nfd("한국어"): "한국어",
        nfd("닭이"): "닭이",
        # A vowel with its place leaves the final where it is, one without takes it.
        first("ㄱ") + vowel("ㅏ") + last("ㄱ") + vowel("ㅏ"): "각ㅏ",
        first("ㄱ") + vowel("ㅏ") + last("ㄱ") + "ㅏ": "가가",
        "ㄱㅏㄱ" + vowel("ㅏ"): "각ㅏ",
        # Letters join within their place; a first letter never ends a syllable.
        first("ㄱ") + vowel("ㅗ") + vowel("ㅏ"): "과",
        first("ㄷ") + vowel("ㅏ") + last("ㄹ") + last("ㄱ"): "닭",
        first("ㄱ") + vowel("ㅏ") + first("ㄱ"): "가ㄱ",
        # Finals without a syllable stand alone; a single one may begin the next, a compound one may not.
        last("ㄳ") + vowel("ㅏ"): "ㄳㅏ",
        last("ㄱ") + vowel("ㅏ"): "가",
        first("ㄱ") + last("ㄴ"): "ㄱㄴ",
        vowel("ㅗ") + vowel("ㅏ") + last("ㄱ"): "ㅘㄱ",
        "ㄱㅏㄸㅏ": "가따",
        "ㄷㅏㄹㄱㅣ": "달기",
        "": "",
        None: None,
    }
    frame = spark.createDataFrame(list(want.items()), "letters string, want string")
    wrong = frame.filter(~F.equal_null("want", hangul.compose(F.col("letters")))).select("letters", "want", hangul.compose(F.col("letters")).alias("got")).collect()
    assert wrong == []
