"""Column expressions against plain loops: common subsequences, romaji, case, encodings, inflections, slips."""

from __future__ import annotations

from random import Random

from pyspark.sql import functions as F

from wordloom.functions import encoding, hangul, kana, typing
from wordloom.operators import evaluation


def subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b, 1):
            row[j] = above[j - 1] + 1 if x == y else max(above[j], row[j - 1])
    return row[-1]


def test_common_subsequences(spark):
    draw = Random(5)
    word = lambda n: "".join(draw.choice("abにわ庭") for _ in range(n))
    pairs = [(word(draw.randrange(9)), word(draw.randrange(9))) for _ in range(200)] + [("", ""), ("", "ab"), ("ab", "")]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", typing.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == subsequence(r["a"], r["b"]) for r in found) and len(found) == len(pairs)
    one = evaluation.conversions(spark.createDataFrame(pairs, "expected string, got string")).collect()[0]
    assert abs(one["characters"] - sum(subsequence(b, a) / max(len(a), 1) for a, b in pairs) / len(pairs)) < 1e-12
    assert abs(one["sentences"] - sum(a == b for a, b in pairs) / len(pairs)) < 1e-12


def test_romaji(spark):
    want = {"kanni": "かんい", "honnya": "ほんや", "konnnichiha": "こんにちは", "hon": "ほん", "gakkou": "がっこう", "matcha": "まっちゃ", "q": "q", "": "", "n'a": "んあ", "Tokyo": "ときょ"}
    frame = spark.createDataFrame([*want.items(), (None, None)], "typed string, want string")
    assert frame.filter(~F.equal_null("want", kana.romaji_to_kana(F.col("typed")))).collect() == []


def test_case_is_restored_only_where_it_was_folded(spark):
    rows = [("Don’t", "don't", "won't", "Won’t"), ("NASA", "nasa", "nato", "NATO"), ("McD", "mcd", "mcdo", "mcdo"), ("İst", "İst", "ist", "ist"), ("ΟΔΟΣ", "οδοσ", "οδοσ", "ΟΔΟΣ"), ("tea", "tea", "tee", "tee"), ("", "", "a", "a")]
    frame = spark.createDataFrame(rows, "typed string, folded string, found string, shown string")
    assert [tuple(r) for r in frame.select("typed", typing.fold(F.col("typed")), "found", typing.restore(F.col("found"), F.col("typed"))).collect()] == rows


def test_encodings(spark):
    one = spark.createDataFrame([("한글", "ガ", "É")], "h string, k string, e string")
    keys = one.select(encoding.encode(F.col("h"), "hangul").alias("h"), encoding.encode(F.col("k"), "kana").alias("k"), encoding.encode(F.col("e"), "utf8").alias("e"), encoding.encode(F.col("k"), "hangul").alias("none"))
    assert tuple(keys.collect()[0]) == ("gksrmf", "が", "É", None)
    assert tuple(keys.select(encoding.decode(F.col("h"), "hangul"), encoding.decode(F.col("k"), "kana")).collect()[0]) == ("한글", "が")
    bytes_ = spark.createDataFrame([("A",), ("É",), ("’",)], "c string").select(encoding.key_byte(F.col("c"), "utf8"), encoding.key_byte(F.col("c"), "hangul"))
    assert [tuple(r) for r in bytes_.collect()] == [("a", None), (None, None), ("'", None)]


def test_words_go_on_from_stems(spark):
    stems = spark.createDataFrame([("먹",), ("예쁘",), ("하",)], "stem string")
    words = ["먹", "먹어", "예뻐", "예뻐서", "해", "하", "가", "tea"]
    found = hangul.grown_from(spark.createDataFrame([(w,) for w in words], "word string"), stems)
    assert sorted(r["word"] for r in found.collect()) == sorted(["먹어", "예뻐", "예뻐서", "해"])


def test_slips_are_one_edit_away(spark):
    near = {"a": {"s"}, "s": {"a", "d"}, "d": {"s"}}
    words = spark.createDataFrame([(w,) for w in ("sad", "dads", "a", "", "x")], "word string")
    pairs = spark.createDataFrame([(b, n) for b, ns in near.items() for n in ns], "base string, near string")
    made = evaluation.synthesise(words, pairs).collect()
    assert {r["word"] for r in made} == {"sad", "dads", "a"}

    def slips(w: str) -> set[str]:
        out = set()
        for i, c in enumerate(w):
            out |= {w[:i] + n + w[i + 1 :] for n in near.get(c, ())} | {w[: i + 1] + n + w[i + 1 :] for n in near.get(c, ())}
            out |= {w[:i] + w[i + 1 :]} if len(w) >= 3 else set()
            out |= {w[:i] + w[i + 1] + c + w[i + 2 :]} if i + 1 < len(w) else set()
        return out - {w}

    assert all(r["typed"] in slips(r["word"]) for r in made)
    assert len({(r["word"], r["case_no"]) for r in made}) == len(made)
