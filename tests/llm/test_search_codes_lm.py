"""Operators 11 to 13: against SQL, plain loops, exact distributions, and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import differences, oracle
from llm_rows import CLASHING, MEDIUM, SMALL, TEXTS
from pyspark.sql import functions as F

from wordloom.llm import block_max, oracles, pitman_yor, queries, vector_codes
from wordloom.llm.language_id import remainder


@pytest.mark.parametrize("name", ["op11_partial_distance", "op12_block_max_wand"])
def test_queries_have_the_rows_of_their_sql(spark, name):
    assert differences(spark, oracle(SMALL), queries.queries()[name], oracles.oracle_sql()[name], SMALL) == ""


# --- Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, integers, label), every vector as long."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda: [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]
    for _ in range(rounds):
        found = near()
        for p, k in itertools.product(range(parts), range(len(books[0]))):
            if own := [c[p] for c, f in zip(cut, found) if f[p][1] == k]:
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = near()
    errors = Counter()
    for (_, _, label), f in zip(rows, found):
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(rows, found)), key=str)


def vectors(spark, rows):
    schema = "vec_id bigint, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in [*CLASHING, "v", "n", "code", "error"])
    return spark.createDataFrame([(*r, *["x"] * (len(CLASHING) + 4)) for r in rows], schema)


def test_codes_of_odd_vectors_are_those_of_plain_loops(spark):
    draw = np.random.default_rng(5)
    good = [(k, [float(x) for x in np.float32(draw.normal(size=16))], [0, 0, 1, None][k % 4]) for k in range(60)]
    good += [(3, good[3][1], 0), (100, [0.0] * 16, None), (101, [-1e-9] * 16, 2), (102, [3e4] * 16, 2), (None, good[0][1], 5)]
    odd = [(200, None, 1), (201, [1.0] * 15 + [float("nan")], 1), (202, [float("inf")] * 16, 1), (203, [1.0] * 15 + [None], 1)]
    short = [(300, [0.5] * 3, 7), (301, [], 7)]
    padded = lambda v: v + [0.0] * (16 - len(v))
    want = plain_codes([(i, [math.floor(4096 * float(np.float32(x))) for x in padded(v)], label) for i, v, label in good + short])
    got = sorted(map(tuple, vector_codes.compress(vectors(spark, good + odd + short)).collect()), key=str)
    assert got == want
    few = good[:5]
    assert sorted(map(tuple, vector_codes.compress(vectors(spark, few)).collect()), key=str) == plain_codes([(i, [math.floor(4096 * x) for x in v], label) for i, v, label in few])
    assert vector_codes.compress(vectors(spark, [])).collect() == vector_codes.compress(vectors(spark, odd)).collect() == []


def test_partial_distances_give_the_nearest_entry_at_any_size():
    draw = np.random.default_rng(6)
    for scale in (3, 1000, 2**40, 2**62):
        rows, book = draw.integers(-scale, scale, (400, 6)), draw.integers(-scale, scale, (9, 6))
        rows[:9], book[4] = book, book[2]
        best, least = vector_codes.nearest(rows, book)
        for row, k, d in zip(rows.tolist(), best.tolist(), least.tolist()):
            assert (int(d), k) == min((sum((a - b) ** 2 for a, b in zip(row, e)), n) for n, e in enumerate(book.tolist()))


# --- Block-Max WAND


def plain_search(docs, items, k=10):
    words = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    texts = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, own in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own if df[t]}
        scored = []
        for i, c in texts:
            size = sum(c.values())
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total))) for t, w in weights.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    whole = block_max.totals(docs)
    return sorted(map(tuple, block_max.search(block_max.build(docs, whole, **more), whole, items).collect()), key=str)


def test_searches_over_many_segments_are_those_of_plain_loops(spark, small, small_rows):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [tuple(r) for r in items.select("item_id", "text").collect()]
    rows += [(900, None), (901, "no such word anywhere zzzzqq"), (902, small_rows[3][1]), (902, "the"), (None, "The THE the"), (903, " ,.;")]
    asked = spark.createDataFrame([(i, t, *["x"] * 4) for i, t in rows], "item_id bigint, text string, rank string, score string, query string, doc_id string")
    want = plain_search(small_rows, rows)
    assert searched(spark, small.repartition(5), asked, segment_bytes=20_000) == want
    assert searched(spark, small, asked) == want


def test_searches_of_odd_documents(spark, odd, empty):
    rows = [(i, t) for i, t, *_ in TEXTS]
    items = [(1, "lazy dog 東京タワー x"), (2, "word5 naïve ÜBERGRÖSSE"), (3, "without"), (4, "short")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert searched(spark, odd, asked) == plain_search(rows, items)
    assert searched(spark, empty, asked) == [] and searched(spark, odd, asked.limit(0)) == []


def test_blocks_below_the_threshold_are_not_decompressed(spark, monkeypatch):
    n = 60 * block_max.BLOCK
    docs = spark.createDataFrame([(k, "rare rare rare common" if k < 12 else "common filler " * 9) for k in range(n)], "doc_id bigint, text string").coalesce(1)
    whole = block_max.totals(docs)
    table = block_max.build(docs, whole).toArrow()
    own = block_max.Postings(table)
    opened = []
    monkeypatch.setattr(own, "doc_numbers", lambda blocks, f=own.doc_numbers: opened.extend(blocks.tolist()) or f(blocks))
    found, _ = own.best([(b"rare", 9000), (b"common", 1)], 10, 1)
    assert found.tolist() == list(range(10)) and len(set(opened)) < 25 < len(own.last)


def test_numbers_are_packed_without_loss():
    values = np.array([0, 1, 127, 128, 300, 2**14, 2**21 - 1, 2**35, 5])
    data, sizes = block_max.put_numbers(values)
    assert block_max.get_numbers(data).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 3, 6, 1]


# --- Hierarchical Pitman-Yor


def plain_base(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]) for i, t in rows]
    rest = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    seen = Counter(w for i, own in words if rest(i) not in (None, 2) for w in own)
    total, kinds = sum(seen.values()), len(seen)
    return sorted((str(i), rest(i) == 2, len(own), sum(seen[w] > 0 for w in own), total, round(sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in own), 5)) for i, own in words)


def scored(docs, **more):
    rest = remainder(F.col("doc_id"), 7)
    return pitman_yor.learn_and_score(docs, rest != 2, rest == 2, **more).collect()


def test_counts_and_base_scores_are_those_of_plain_loops(spark, odd, empty, small, small_rows):
    for docs, rows, size in ((odd, [(i, t) for i, t, *_ in TEXTS], 300_000), (small, small_rows, 20_000), (small, small_rows, 10**9)):
        got = scored(docs, bucket_bytes=size)
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == plain_base(rows)
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert scored(empty) == []
    unlearnt = pitman_yor.learn_and_score(odd, F.lit(False), F.lit(True)).collect()
    assert len(unlearnt) == len(TEXTS) and {r["n_known"] for r in unlearnt} == {0} and {round(r["score"], 9) for r in unlearnt} == {0.0}


def test_pairs_that_are_split_score_as_others_do(spark):
    """One short text many times over: its pairs are a third of all."""
    rows = [(k, "the same short text" if k % 2 else f"a{k % 50} b{k % 31} the c{k % 17} same {k}") for k in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = docs.select("text", F.col("doc_id").alias("id"), F.lit(False).alias("held_out"), F.lit(True).alias("train"))
    deal = pitman_yor.deal_out(plain, 2_000)
    assert (b"the", b"same") in deal.hot_pairs and b"the" in deal.hot_words and deal.buckets > 10
    split, whole = ({r["doc_id"]: r for r in scored(docs, bucket_bytes=size)} for size in (2_000, 10**9))
    assert [(r["n_known"], round(r["base_score"], 6)) for r in map(split.get, range(1_200))] == [(r["n_known"], round(r["base_score"], 6)) for r in map(whole.get, range(1_200))]
    assert len({round(r["score"], 6) for k, r in split.items() if k % 2}) == 1
    assert abs(split[1]["score"] - whole[1]["score"]) < 0.05 * abs(whole[1]["score"])


def test_held_out_texts_are_likelier_than_by_single_tokens(spark):
    got = queries.op13_pitman_yor(spark, MEDIUM).collect()
    held = [r for r in got if r["held_out"]]
    perplexity = lambda c: 10 ** (-sum(r[c] for r in held) / sum(r["n_tokens"] for r in held))
    assert held and perplexity("score") < 0.5 * perplexity("base_score")


def test_seating_follows_the_exact_distribution_of_tables():
    """One dish of five customers: the number of tables, against the sum over all seatings."""
    discount, strength, chance, customers, others = 0.4, 1.5, 0.2, 5, 3
    weights = Counter()

    def seat(sizes: list[int], weight: float) -> None:
        if sum(sizes) == customers:
            weights[len(sizes)] += weight
            return
        for k, n in enumerate(sizes):
            seat([*sizes[:k], n + 1, *sizes[k + 1 :]], weight * (n - discount))
        seat([*sizes, 1], weight * (strength + discount * (others + len(sizes))) * chance)

    seat([1], 1.0)
    n = 3_000
    seating = pitman_yor.Seating(np.full(n, customers), np.arange(n), np.full(n, others), np.full(n, chance), discount, strength, np.random.default_rng(1))
    seen = Counter()
    for turn in range(140):
        seating.step(np.arange(n))
        if turn >= 60:
            seen.update(seating.tables.tolist())
    assert (np.bincount(seating.dish, weights=seating.size, minlength=n) == customers).all() and (np.bincount(seating.dish, minlength=n) == seating.tables).all()
    assert (seating.all_tables == others + seating.tables).all()
    for tables in range(1, customers + 1):
        assert abs(seen[tables] / sum(seen.values()) - weights[tables] / sum(weights.values())) < 0.01


@pytest.mark.parametrize("customers, discount, others, chance", [(400, 0.5, 20, 0.3), (2_000, 0.4, 60, 0.2), (3, 0.75, 50, 0.01)])
def test_a_sweep_moves_all_customers_of_a_dish(customers, discount, others, chance):
    """Mean tables after few sweeps, against those by generalised Stirling numbers."""
    ways = np.full(customers + 2, -np.inf)
    ways[1] = 0.0
    for n in range(1, customers):
        t = np.arange(1, n + 1)
        joined = ways[1 : n + 1] + np.log(n - discount * t)
        ways[2 : n + 2] = ways[1 : n + 1]
        ways[1] = -np.inf
        ways[1 : n + 1] = np.logaddexp(ways[1 : n + 1], joined)
    t = np.arange(1, customers + 1)
    weights = ways[1 : customers + 1] + np.cumsum(np.log((1.0 + discount * (others + t - 1)) * chance))
    weights = np.exp(weights - weights.max())
    want = (weights * t).sum() / weights.sum()
    n = 500
    seating = pitman_yor.Seating(np.full(n, customers), np.arange(n), np.full(n, others), np.full(n, chance), discount, 1.0, np.random.default_rng(1))
    mean = seating.sample(pitman_yor.Settings())
    assert (np.bincount(seating.dish, weights=seating.size, minlength=n) == customers).all() and seating.size.min() > 0
    assert abs(mean.mean() - want) < 0.06 * want
    # From one table as well: none of its customers stays because others went before it.
    seating.tables, seating.all_tables, seating.dish, seating.size = np.ones(n, dtype=np.int64), np.full(n, others + 1), np.arange(n), np.full(n, customers)
    for _ in range(40):
        seating.step(np.arange(n))
    assert abs(np.mean([(seating.step(np.arange(n)), seating.tables.mean())[1] for _ in range(20)]) - want) < 0.05 * want


def test_probabilities_of_a_restaurant_sum_to_one(spark):
    rows = [(k, f"a{k % 3} b{k % 5} c a{k % 7} b{k % 2}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = F.col("doc_id") < 79
    known = sorted({w for _, t in rows[:79] for w in t.split()})
    asked = spark.createDataFrame([(1000 + k, w) for k, w in enumerate([*known, "unknown"])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.learn_and_score(docs.unionByName(asked), train, ~train).collect()}
    assert all(x < 0 for x in got.values())
    plain = docs.unionByName(asked).select("text", F.col("doc_id").alias("id"), (~train).alias("held_out"), train.alias("train"))
    model = pitman_yor.fit(plain, pitman_yor.Settings())
    (seated,), answers = model.seated.collect(), model.replies.toArrow()
    chance = model.chances.of(answers)
    known_words = model.chances.known
    heads = np.frombuffer(seated["heads"], dtype=np.uint64)
    unknown = (model.chances.settings.parent_strength + model.chances.settings.parent_discount * model.chances.tables) / (known_words.words + 1) / (model.chances.settings.parent_strength + model.chances.customers)
    assert len(heads) == len(chance) and abs(chance.sum() - 1) < 1e-5  # the unknown one is among the asked
    assert abs(chance.min() - unknown) < 1e-9
