"""Operators 1, 3, 8 and 9: against SQL, plain code and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from compare import differences, oracle
from llm_rows import CLASHING, MEDIUM, SMALL, TEXTS, frame, rows_by
from pyspark.sql import functions as F

from wordloom.llm import components, mixing, ngram_join, nn_descent, oracles, queries, sharding


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_native_queries_give_the_rows_of_sql(spark, name):
    assert differences(spark, oracle(SMALL), queries.queries()[name], oracles.oracle_sql()[name], SMALL) == ""


# --- Mixing


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)]
    leaves = spark.createDataFrame(rows, "top string, low string, tokens bigint")
    got = {(r["top"], r["low"]): r["budget"] for r in mixing.allocate(leaves, mixing.Mixture(("top", "low"), budget_share=(1, 2))).collect()}
    # 1005 in all: 502 or 503 each; x has but 10, and y, its sibling, takes the rest.
    assert got["a", "x"] == 10 and got["a", "x"] + got["a", "y"] in (502, 503) and sum(got.values()) == 1005
    rows = [("a", "x", 10), ("a", "y", 20), ("b", "z", 1000)]
    leaves = spark.createDataFrame(rows, "top string, low string, tokens bigint")
    got = {r["low"]: r["budget"] for r in mixing.allocate(leaves, mixing.Mixture(("top", "low"), budget_share=(1, 2))).collect()}
    assert got == {"x": 10, "y": 20, "z": 485}


def test_a_leaf_spends_its_budget_whole(odd, empty):
    mixture = mixing.Mixture(("lang", "source"), {"en": 300, "src9": 7}, max_epochs=2)
    rows = mixing.mix(odd, mixture).collect()
    assert len(rows) == len(TEXTS) and all(r["tokens_used"] <= 2 * r["n_tokens"] for r in rows)
    assert sum(r["tokens_used"] for r in rows) == sum(r["n_tokens"] for r in rows)
    assert all(r["tokens_used"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    assert mixing.mix(empty, mixture).collect() == []


def test_mixing_uses_no_python(spark):
    plan = queries.op1_source_mixing(spark, SMALL)._jdf.queryExecution().toString() + queries.op9_lookup_sharding(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions", "ExternalRDD"))


# --- Sharding


def test_every_slot_has_an_owner_and_shards_are_even(spark):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(spark, names, 101).collect()
    assert sorted(r["slot"] for r in table) == list(range(101))
    owned = [sum(r["shard"] == n for r in table) for n in names]
    assert max(owned) - min(owned) <= 1
    fewer = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, names[:-1], 101).collect()}
    stayed = sum(fewer[r["slot"]] == r["shard"] for r in table if r["shard"] != "s6")
    assert stayed > 0.5 * sum(r["shard"] != "s6" for r in table)


def test_sharding_of_odd_keys(spark, odd, empty):
    table = sharding.lookup_table(spark, ["a", "b"], 11)
    rows = sharding.place(odd, "doc_id", table, 11).collect()
    assert len(rows) == len(TEXTS) and len({r["shard"] for r in rows if r["doc_id"] == 9}) == 1
    assert sharding.place(empty, "doc_id", table, 11).collect() == []
    for bad in ((["a"], 12), ([], 11), (["a", "a"], 11)):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, *bad)


# --- N-gram join


def plain_sets(rows, words=5):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    return out


def plain_components(rows, pct=80):
    """(id, set size, least id reachable) of every row: all pairs compared."""
    sets = plain_sets(rows)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * min(len(a), len(b)) >= pct * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= pct * (len(a) + len(b) - shared):
                    root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(d, len(s), least.get(find(k)) if s else d) for k, (d, s) in enumerate(sets)]


@pytest.fixture(scope="module")
def near():
    """Chains of near copies, a large group of them, a common shingle, texts of few words, sets on the very border."""
    draw = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in draw.integers(0, 5000, n)]
    texts = []
    base = word(80)
    for _ in range(60):
        own = list(base)
        own[int(draw.integers(80))] = "changed"
        texts.append(" ".join(own))
    texts += [" ".join(base[k : k + 60]) for k in range(0, 20)]
    for n in (1, 2, 4, 5, 6, 9, 13, 14):
        own = word(n)
        texts += [" ".join(own), " ".join(own).upper(), " ".join([*own, "more"]), " ".join(own[:-1])]
    common = word(7)
    texts += [" ".join([*word(int(n)), *common]) for n in draw.integers(1, 60, 60)]
    texts += [" ".join(base), "", None, "  \t "]
    order = draw.permutation(len(texts))
    return [(int(3 * k + 1), texts[int(o)]) for k, o in enumerate(order)]


def test_components_are_those_of_all_pairs(spark, odd, small, small_rows, near):
    frames = [(spark.createDataFrame(near, "doc_id bigint, text string").repartition(3), near), (small, small_rows), (odd, [(i, t) for i, t, *_ in TEXTS])]
    for docs, rows in frames:
        assert rows_by(ngram_join.linked_components(docs).collect()) == rows_by(plain_components(rows))


def test_heads_of_linked_sets_share_enough():
    """Sets that overlap just enough, drawn as ranks in the order of hashes."""
    draw = np.random.default_rng(5)
    for pct in (1, 37, 80, 100):
        for _ in range(400):
            n = int(draw.integers(1, 120))
            lacking = int(draw.integers(0, n - ngram_join._least(n, pct) + 1))
            shared = n - lacking
            extra = int(draw.integers(0, shared * 100 // pct - n + 1))
            ranks = draw.permutation(n + extra)
            one, other = np.sort(ranks[:n]), np.sort(np.append(ranks[lacking:n], ranks[n:]))
            assert 100 * shared >= pct * (n + extra)
            heads = [set(x[: ngram_join.head_length(len(x), pct)].tolist()) for x in (one, other)]
            assert len(heads[0]) == ngram_join.head_length(n, pct) <= n
            assert len(heads[0] & heads[1]) >= max(ngram_join.head_shared(len(x), pct) for x in (one, other))


def test_texts_without_partners_are_out_by_their_heads(spark):
    """Texts that share a line of ten words: a third of their shingles is dealt, and none is read again."""
    draw = np.random.default_rng(2)
    line = " ".join(f"line{k}" for k in range(10))
    alone = [(k, line + " " + " ".join(f"w{x}" for x in draw.integers(0, 1 << 40, 290))) for k in range(60)]
    rows = [*alone, (100, alone[0][1]), (101, alone[1][1] + " more")]
    docs = spark.createDataFrame(rows, "text_id bigint, text string").selectExpr("text", "text_id as id").repartition(3)
    table = ngram_join._documents(docs, 5, 80, 4)
    by_key = {r["key"]: r["doc_id"] for r in table.filter("kind = 0 and doc_id < 100 or doc_id = 101").collect()}
    left = {by_key[r["key"]] for r in table.filter("kind = 1").collect()} - {100}
    assert left - {0, 100} == {1, 101}
    assert ngram_join.head_length(296, 80) == 59 + 24


def test_other_thresholds(spark, near):
    docs = spark.createDataFrame(near, "doc_id bigint, text string")
    assert rows_by(ngram_join.linked_components(docs, pct=100).collect()) == rows_by(plain_components(near, 100))
    assert rows_by(ngram_join.linked_components(docs, pct=60).collect()) == rows_by(plain_components(near, 60))


def edited(draw, base, edits):
    own = list(base)
    for at in draw.integers(0, len(base), edits):
        own[int(at)] = f"e{draw.integers(1 << 30)}"
    return own


def test_frequent_shingles_rings_and_rounds(spark, near, monkeypatch):
    """Lines that all share, copies that link in chains only, a large group linked by the third; few places for all."""
    draw = np.random.default_rng(11)
    line = [f"line{k}" for k in range(12)]
    base = [f"b{k}" for k in range(90)]
    texts = [" ".join([*line, *(f"x{draw.integers(1 << 30)}" for _ in range(int(n)))]) for n in draw.integers(0, 9, 80)]
    texts += [" ".join([*edited(draw, base, int(n)), *line]) for n in draw.integers(0, 4, 150)]
    chain = list(base[::-1])
    for k in range(40):  # each differs from the next by two words, from others by more
        chain = [*chain[2:], f"c{2 * k}", f"c{2 * k + 1}"]
        texts.append(" ".join(chain))
    rows = [*near, *((10_000 + 7 * k, t) for k, t in enumerate(texts)), *((20_000 + k, texts[100]) for k in range(50))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = rows_by(plain_components(rows))
    assert rows_by(ngram_join.linked_components(docs).collect()) == want
    for name, value in (("LOCAL", 3), ("FREQUENT", 4), ("BIN_HELD", 50), ("HELD", 2000), ("RING", 8), ("ROUNDS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    assert rows_by(ngram_join.linked_components(docs).collect()) == want
    monkeypatch.setattr(ngram_join, "LOCAL", 1 << 20)
    assert rows_by(ngram_join.linked_components(docs).collect()) == want


def test_words_that_polynomial_hashes_confuse(spark):
    one, other = ("".join("ab"[(bin(k).count("1") + way) % 2] for k in range(4096)) for way in (0, 1))
    rows = [(k, f"{w} two three four five six") for k, w in enumerate((one, other))] + [(7, "a b c d e"), (8, "A B c d E")]
    got = ngram_join.linked_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert rows_by(got) == rows_by(plain_components(rows))


def test_no_documents_no_links(spark, empty):
    assert ngram_join.linked_components(empty).collect() == []
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, k) for k in range(1001, 1500)]
    got = {r["u"]: r["component"] for r in components.components(spark.createDataFrame([*chain, *star, (7, 7)], "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, **{k: 1000 for k in range(1001, 1500)}}


# --- Nearest neighbours


def exact(ids, x, queries_, k):
    out = []
    for q in queries_:
        score = (x * x[q]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-score[i], ids[i]))[:k]
        out += [(ids[q], n + 1, ids[i], score[i]) for n, i in enumerate(order)]
    return out


def test_nearest_neighbours_are_found(spark):
    table = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    want = exact(ids, x, [k for k, i in enumerate(ids) if i % 20 == 0], 20)
    got = queries.op8_nn_descent(spark, MEDIUM).collect()
    assert len(got) == len(want)
    hits = {(q, i) for q, _, i, _ in want} & {(r["query_id"], r["vec_id"]) for r in got}
    assert len(hits) >= 0.9 * len(want)
    place = {i: k for k, i in enumerate(ids)}
    for r in got[:200]:
        assert abs(r["score"] - (x[place[r["query_id"]]] * x[place[r["vec_id"]]]).sum()) < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for own in by.values():
        own.sort()
        assert [o[0] for o in own] == list(range(1, 21)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_a_larger_graph_reaches_nine_tenths(spark):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(40, 24))
    x = (centres[draw.integers(0, 40, 6000)] + 0.6 * draw.normal(size=(6000, 24))).astype(np.float32).astype(np.float64)
    ids = list(range(6000))
    asked = ids[::120]
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in ids], "vec_id bigint, embedding array<float>").repartition(4)
    got = nn_descent.nearest(table, lambda c: F.col(c) % 120 == 0, plan=nn_descent.Plan(block=400)).collect()
    want = {(q, i) for q, _, i, _ in exact(ids, x, asked, 20)}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def test_vectors_alone_in_their_boxes_are_linked(spark):
    """A cone, and ten vectors and one more opposite to it."""
    draw = np.random.default_rng(5)
    x = 0.03 * draw.normal(size=(3011, 16))
    x[:3000, 0] += 1
    x[3000:3010, :2] += (-1, 1)
    x[3010, :2] += (-1, -1)
    ids = list(range(len(x)))
    asked = [*range(0, 3000, 100), *range(3000, 3011)]
    table = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id bigint, embedding array<double>").repartition(4)
    got = nn_descent.nearest(table, lambda c: F.col(c).isin(asked), plan=nn_descent.Plan(block=100, tables=3)).collect()
    counts = {q: sum(r["query_id"] == q for r in got) for q in asked}
    assert counts == {q: 20 for q in asked}
    want = {(q, i) for q, n, i, _ in exact(ids, x, asked, 20) if q < 3000 or n <= 10}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)
    assert {(q, i) for q, i in want if q >= 3000} <= {(r["query_id"], r["vec_id"]) for r in got}


def test_the_least_ids_of_equal_vectors_come_first(spark):
    """A third of the rows are one vector, more than lists and beams hold, and ids are not in the rows' order."""
    draw = np.random.default_rng(6)
    x = np.round(draw.normal(size=(1200, 8)), 2)
    x[draw.permutation(1200)[:400]] = 1.5
    ids = list(range(1200))
    asked = ids[::24]
    table = spark.createDataFrame([(i, x[i].tolist()) for i in ids[::-1]], "vec_id bigint, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nn_descent.nearest(table, lambda c: F.col(c) % 24 == 0).collect()}
    want = exact(ids, x, asked, 20)
    assert len(got) == len(want) == 20 * len(asked)
    same = [(q, n, i) for q, n, i, _ in want if (x[q] == 1.5).all()]
    assert same and all(got[q, n][0] == i for q, n, i in same)
    assert sum(got[q, n][0] == i for q, n, i, _ in want) >= 0.9 * len(want)


def test_vectors_that_are_all_equal(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in nn_descent.nearest(table, lambda c: F.col(c) % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 3, 5.0), (100, 1, 0, 5.0), (100, 2, 1, 5.0), (100, 3, 2, 5.0)]


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, -0.5]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (20, [0.0, 1.0]), (40, [0.0, 0.0]), (None, [9.0, 9.0])]
    table = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], "vec_id bigint, embedding array<double>, " + ", ".join(f"`{c}` string" for c in CLASHING))
    got = [tuple(r) for r in nn_descent.nearest(table, lambda c: F.col(c) % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0), (20, 3, 2, -0.5)]
    assert nn_descent.nearest(table.limit(0), lambda c: F.col(c) % 20 == 0).collect() == []


def test_frame_is_as_said(spark):
    assert frame(spark, TEXTS).count() == len(TEXTS)
