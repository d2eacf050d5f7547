"""Conversion of readings of any length."""

from __future__ import annotations

import random

from wordloom.operators import conversion, evaluation

SCHEMA = "reading string, surface string, left_id int, right_id int, cost int, dependent boolean"


def _best(text: str, entries: list[tuple], cells: dict, shape: tuple[int, int]) -> set[tuple]:
    """Every cheapest path of a lattice as its segments, by trying all paths."""
    joint = lambda a, b: cells.get((a, b), 0) if a < shape[0] and b < shape[1] else conversion.OUTSIDE_COST
    done = []

    def go(at: int, right: int, total: int, path: list[tuple]) -> None:
        if at == len(text):
            done.append((total + joint(right, 0), path))
            return
        for r, s, a, b, c, dependent in entries:
            if text.startswith(r, at):
                go(at + len(r), b, total + joint(right, a) + c, [*path, (r, s, dependent, False)])
        go(at + 1, 0, total + joint(right, 0) + conversion.UNKNOWN_COST, [*path, (text[at], text[at], False, True)])

    go(0, 0, 0, [])
    least = min(t for t, _ in done)
    found = set()
    for total, path in done:
        if total == least:
            out, unknown = [], False
            for r, s, dependent, alone in path:
                if out and (dependent or alone and unknown):
                    out[-1] = (out[-1][0] + r, out[-1][1] + s)
                else:
                    out.append((r, s))
                unknown = alone
            found.add(tuple(out))
    return found


def test_lattices_solved_together_are_the_cheapest_of_all_paths(spark):
    draw = random.Random(7)
    readings = sorted({"".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(25)})
    entries = [(r, f"{r.upper()}{k}", draw.randrange(5), draw.randrange(5), draw.randrange(200, 6000), draw.random() < 0.2) for r in readings for k in range(2)]
    cells, shape = {(r, c): draw.randrange(-800, 2500) for r in range(4) for c in range(4) if draw.random() < 0.8}, (4, 4)
    texts = [(k % 17 if k % 9 else None, "".join(draw.choices("abcd", k=draw.randint(0, 7)))) for k in range(60)] + [(3, None), (4, "a" * 9)]
    matrix = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, cost int")
    asked = spark.createDataFrame(texts, "sentence_id int, reading string")
    dictionary = spark.createDataFrame(entries, SCHEMA)
    want: dict = {}
    for key, text in set(texts):
        if text:
            want.setdefault(key, []).append(_best(text, entries, cells, shape))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for step in (1, 40, conversion.SOLVED_TOGETHER):
            rows = conversion.convert(asked, dictionary, matrix, shape, step=step).collect()
            got: dict = {}
            for r in rows:  # a sentence's segments come in order, from 1 on
                if r["segment"] == 1:
                    got.setdefault(r["sentence_id"], []).append([])
                got[r["sentence_id"]][-1].append((r["reading"], r["surface"]))
            assert got.keys() == want.keys()
            for key, paths in got.items():
                assert len(paths) == len(want[key])
                left = list(want[key])
                for path in paths:
                    left.remove(next(w for w in left if tuple(path) in w))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_are_those_substrings_that_may_be_readings(spark):
    entries = spark.createDataFrame([("ab", "1", 0, 0, 1, False), ("abc", "2", 0, 0, 1, False), ("b", "3", 0, 0, 1, False), ("", "4", 0, 0, 1, False), (None, "5", 0, 0, 1, False)], SCHEMA)
    asked = spark.createDataFrame([(1, "abdb"), (2, ""), (3, None)], "sentence_id int, reading string")
    got = sorted((r["sentence_id"], r["start"], r["length"], r["reading"]) for r in conversion.spans_of(asked, entries).collect())
    assert got == [(1, 0, 2, "ab"), (1, 0, 3, "abd"), (1, 1, 1, "b"), (1, 3, 1, "b")]
    assert conversion.spans_of(asked, entries.limit(0)).count() == 0


def test_reachable_segments(spark):
    cases = spark.createDataFrame([(1, "庭の木"), (2, "記者"), (3, None), (4, "空")], "sentence_id int, expected string")
    segments = spark.createDataFrame([(1, 1, "にわ"), (1, 2, "のき"), (2, 1, "きしゃ"), (3, 1, "にわ")], "sentence_id int, segment int, reading string")
    offered = spark.createDataFrame([("にわ", "二羽"), ("にわ", "庭"), ("きしゃ", "汽車"), ("きしゃ", "記者")], "reading string, surface string")
    assert evaluation.reachable(cases, segments, offered).collect()[0]["reachable"] == (0.5 + 1 + 0 + 0) / 4
    assert evaluation.reachable(cases.limit(0), segments, offered).collect()[0]["reachable"] == 0


def test_long_readings_are_candidates(spark):
    long = "".join(chr(0x3042 + k) for k in range(40))
    schema = "reading string, surface string, left_id int, right_id int, cost int, dependent boolean"
    entries = spark.createDataFrame([(long, "NAME", 1, 1, 100, False), (long[:20], "half", 1, 1, 5000, False)], schema)
    sentences = spark.createDataFrame([(1, long)], "sentence_id int, reading string")
    assert [tuple(r) for r in conversion.convert(sentences, entries).collect()] == [(1, 1, long, "NAME")]
    assert [r["surface"] for r in conversion.convert(sentences, entries.limit(0)).collect()] == [long]


def test_a_segment_keeps_its_kana_and_nine_spellings(spark):
    schema = "reading string, surface string, left_id int, right_id int, cost int, dependent boolean"
    many = [("かな", f"s{k}", 1, 1, 100 + k, False) for k in range(12)]
    entries = spark.createDataFrame([("にわ", "庭", 1, 1, 10, False), ("にわ", "にわ", 1, 1, 5, False), *many], schema)
    asked = spark.createDataFrame([("にわ",), ("かな",), ("ほか",), ("",), (None,), ("にわ",)], "reading string")
    found = sorted((r["reading"], r["place"], r["surface"]) for r in conversion.segment_candidates(asked, entries).collect())
    want = [("にわ", 1, "にわ"), ("にわ", 2, "庭"), ("にわ", 3, "ニワ"), ("ほか", 1, "ほか"), ("ほか", 2, "ホカ"), *[("かな", k + 1, f"s{k}") for k in range(9)]]
    assert found == sorted(want)


def test_readings_being_typed_offer_themselves_first(spark):
    schema = "reading string, surface string, left_id int, right_id int, cost int, dependent boolean"
    entries = spark.createDataFrame([("にわ", "庭", 1, 1, 10, False), ("にわし", "庭師", 1, 1, 20, False)], schema)
    asked = spark.createDataFrame([("にわ",), ("",), (None,), ("にわ",)], "reading string")
    found = [(r["place"], r["key"], r["text"]) for r in conversion.composing(asked, entries).orderBy("place").collect()]
    # The whole conversion is 庭 as well as the nearest prediction: it stands once.
    assert found == [(1, "にわ", "にわ"), (2, "にわ", "庭"), (3, "にわし", "庭師")]
    assert conversion.composing(asked.limit(0), entries).count() == 0
