"""Hangul as column expressions: syllables to letters and back, the two-set keyboard's ASCII, particles, inflections.

Syllables are taken apart and put together by arithmetic on code points; a run of letters is cut into syllables by one
regular expression, whose look-ahead leaves a final consonant to the next syllable when a vowel follows.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters by place in a syllable, letters made of two keystrokes, and the keyboard's ASCII.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
DOUBLE = {
    "ㅘ": "ㅗㅏ", "ㅙ": "ㅗㅐ", "ㅚ": "ㅗㅣ", "ㅝ": "ㅜㅓ", "ㅞ": "ㅜㅔ", "ㅟ": "ㅜㅣ", "ㅢ": "ㅡㅣ",
    "ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ",
}
KEYS = "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔㅁㄴㅇㄹㅎㅗㅓㅏㅣㅋㅌㅊㅍㅠㅜㅡㅃㅉㄸㄲㅆㅒㅖ"
ASCII = "qwertyuiopasdfghjklzxcvbnmQWERTOP"
#: Particles after a consonant and after a vowel; suffixes that make nouns verbs; vowels that contract.
PARTICLES = (
    ("은", "는"), ("이라고", "라고"), ("이라는", "라는"), ("이", "가"), ("을", "를"), ("과", "와"), ("으로", "로"), ("이나", "나"),
    ("이라", "라"), ("이야", "야"), ("이다", "다"), ("이에요", "예요"), ("입니다", "입니다"), ("도", "도"), ("만", "만"), ("에", "에"),
    ("에서", "에서"), ("에게", "에게"), ("한테", "한테"), ("까지", "까지"), ("부터", "부터"), ("처럼", "처럼"), ("보다", "보다"), ("의", "의"),
)
SUFFIXES = ("하", "되")
PARTICLE_COST = 200
CONTRACTIONS = {"ㅏ": ("ㅐ",), "ㅣ": ("ㅕ",), "ㅡ": ("ㅓ", "ㅏ")}

_FIRST = 0xAC00
_SYLLABLE = "^[가-힣]$"
_VOWEL = "[ㅏ-ㅣ]"


def _units(letter: str) -> str:
    return DOUBLE.get(letter, letter)


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _map(pairs) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs)))


def final_consonant(word: Column) -> Column:
    """Whether the last syllable ends in a consonant; NULL where the last character is no syllable."""
    last = F.right(word, F.lit(1))
    return F.when(last.rlike(_SYLLABLE), (F.ascii(last) - _FIRST) % 28 != 0)


def decompose(word: Column) -> Column:
    """The letters as they are typed; NULL where the word holds anything but Hangul."""
    single = _map([(x, _units(x)) for x in dict.fromkeys(INITIALS + MEDIALS + FINALS)])
    parts = [_array(map(_units, INITIALS)), _array(map(_units, MEDIALS)), _array(["", *map(_units, FINALS)])]

    def letters(c: Column) -> Column:
        n = F.ascii(c) - _FIRST
        whole = F.concat(F.get(parts[0], F.floor(n / 588).cast("int")), F.get(parts[1], F.floor(n / 28).cast("int") % 21), F.get(parts[2], n % 28))
        return F.when(c.rlike(_SYLLABLE), whole).otherwise(F.try_element_at(single, c))

    return F.when(word.rlike("^[가-힣ㄱ-ㅣ]*$"), F.array_join(F.transform(F.split(word, ""), letters), ""))


def _either(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


#: Letters that tell their place (U+1100 first, U+1161 middle, U+11A8 last, each in the order above), and the same without.
PLACED = "".join(chr(start + k) for start, letters in ((0x1100, INITIALS), (0x1161, MEDIALS), (0x11A8, FINALS)) for k in range(len(letters)))
UNPLACED = INITIALS + MEDIALS + FINALS
_PLACED_FIRST, _PLACED_VOWEL = f"{PLACED[0]}-{PLACED[18]}", f"{PLACED[19]}-{PLACED[39]}"


def _last(letter: str) -> str:
    """A final with its place."""
    return PLACED[40 + FINALS.index(letter)]


def _vowel(letter: str) -> str:
    return PLACED[19 + MEDIALS.index(letter)]


# A letter may come with its place or without. Only a vowel without one takes the final before it.
_PAIRED_VOWELS = "|".join(f"[{v[0]}{_vowel(v[0])}][{v[1]}{_vowel(v[1])}]" for k, v in DOUBLE.items() if k in MEDIALS)
_PAIRED_FINALS = "|".join(f"[{v[0]}{_last(v[0])}][{v[1]}{_last(v[1])}]" for k, v in DOUBLE.items() if k in FINALS)
_ALONE = [x for x in FINALS if x in INITIALS]
_COMPOUND = "".join(_last(x) for x in FINALS if x not in INITIALS)
_LEAD = f"[{INITIALS}{_PLACED_FIRST}{''.join(map(_last, _ALONE))}]"
_FINAL = f"(?:{_PAIRED_FINALS}|[{''.join(x + _last(x) for x in _ALONE)}])(?!{_VOWEL})|[{_COMPOUND}]"
_PIECE = f"{_LEAD}(?:{_PAIRED_VOWELS}|[ㅏ-ㅣ{_PLACED_VOWEL}])(?:{_FINAL})?|{_PAIRED_VOWELS}|."


def keycaps(letters: Column) -> Column:
    """Letters without their places."""
    return F.translate(letters, PLACED, UNPLACED)


def conjoin(word: Column) -> Column:
    """Syllables as letters with their places; other characters stay."""
    part = lambda start, k: _character(F.lit(start) + k)

    def letters(c: Column) -> Column:
        n = F.ascii(c) - _FIRST
        last = n % 28
        return F.when(c.rlike(_SYLLABLE), F.concat(part(0x1100, F.floor(n / 588)), part(0x1161, F.floor(n / 28) % 21), F.when(last > 0, part(0x11A7, last)).otherwise(""))).otherwise(c)

    return F.array_join(F.transform(F.split(word, ""), letters), "")


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def compose(letters: Column) -> Column:
    """Syllables of typed letters, with their places or without; letters that make none stand alone."""
    joined = {v: k for k, v in DOUBLE.items()}
    vowels = _map([(v, i) for i, x in enumerate(MEDIALS) for v in {x, _units(x)}])
    finals = _map([(v, i + 1) for i, x in enumerate(FINALS) for v in {x, _units(x)}])
    lone = _map([(v, k) for v, k in joined.items() if k in MEDIALS])

    def syllable(piece: Column) -> Column:
        first = F.instr(F.lit(INITIALS), F.left(piece, F.lit(1))) - 1
        vowel = F.regexp_extract(piece, f"{_VOWEL}+", 0)
        last = F.regexp_extract(piece, f"{_VOWEL}([ㄱ-ㅎ]*)$", 1)
        code = _FIRST + (first * 21 + F.try_element_at(vowels, vowel)) * 28 + F.coalesce(F.try_element_at(finals, last), F.lit(0))
        return F.when(piece.rlike(f"^[ㄱ-ㅎ]{_VOWEL}"), _character(code)).otherwise(F.coalesce(F.try_element_at(lone, piece), piece))

    return F.array_join(F.transform(F.regexp_extract_all(letters, F.lit(f"({_PIECE})"), F.lit(1)), lambda piece: syllable(keycaps(piece))), "")


def encode(word: Column) -> Column:
    """A word's key on the two-set keyboard, one ASCII character a keystroke; NULL where it is no Hangul. Letters with their places have the keys of those without."""
    return F.translate(decompose(keycaps(word)), KEYS, ASCII)


def decode(key: Column) -> Column:
    """The word of a key; NULL where a character is no key."""
    return F.when(key.rlike(f"^[{ASCII}]*$"), compose(F.translate(key, ASCII, KEYS)))


def particle_forms() -> list[str]:
    return sorted({form for pair in PARTICLES for form in pair})


def inflection_key(word: Column) -> Column:
    return F.coalesce(decompose(word), word)


def stem_keys(stems: DataFrame) -> DataFrame:
    """(key, contracted) of stems(stem): each bare, and with the last vowel as it contracts."""
    key = inflection_key(F.col("stem"))
    bare = stems.select(key.alias("key"), F.lit(False).alias("contracted")).filter("key <> ''")
    shorter = F.substring("key", F.lit(1), F.char_length("key") - 1)
    forms = _map([(v, ",".join(to)) for v, to in CONTRACTIONS.items()])
    to = F.explode(F.split(F.try_element_at(forms, F.right("key", F.lit(1))), ","))
    return bare.unionByName(bare.select(shorter.alias("shorter"), to.alias("to")).select(F.concat("shorter", "to").alias("key"), F.lit(True).alias("contracted"))).distinct()


def grown_from(words: DataFrame, stems: DataFrame) -> DataFrame:
    """The words that go on from a bare stem, or from a contracted one or are it: prefixes meet stems as equal strings."""
    key = inflection_key(F.col("word"))
    n = F.char_length(key)
    cut = words.withColumn("n", n).select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.substring(key, F.lit(1), i).alias("key"), i.alias("i")))).alias("p")).select("word", "n", "p.key", "p.i")
    met = cut.join(stem_keys(stems), "key").filter(F.col("contracted") | (F.col("i") < F.col("n")))
    return met.select("word").distinct()


def commonest(nouns: DataFrame, most: int) -> DataFrame:
    """(word, cost): the `most` cheapest nouns, ties in order of the word; repeated rows count once."""
    return nouns.select("word", "cost").distinct().orderBy("cost", "word").limit(most)


def expand_particles(nouns: DataFrame, known: DataFrame) -> DataFrame:
    """(word, cost) of nouns(word, cost) with each particle that suits their last syllable, at PARTICLE_COST more, unless known(word) has the word."""
    pairs = F.array(*[F.struct(F.lit(a).alias("after_consonant"), F.lit(b).alias("after_vowel")) for a, b in PARTICLES])
    ends = final_consonant(F.col("word"))
    met = nouns.filter(ends.isNotNull()).select("word", "cost", ends.alias("ends"), F.inline(pairs))
    form = F.when(F.col("ends"), F.col("after_consonant")).otherwise(F.col("after_vowel"))
    made = met.select(F.concat("word", form).alias("word"), (F.col("cost") + PARTICLE_COST).alias("cost"))
    return made.groupBy("word").agg(F.min("cost").alias("cost")).join(known.select("word"), "word", "left_anti")


def derived_stems(nouns: DataFrame) -> DataFrame:
    """(word): each noun with the suffixes that make it a verb."""
    return nouns.select(F.explode(F.array(*[F.concat("word", F.lit(x)) for x in SUFFIXES])).alias("word"))
