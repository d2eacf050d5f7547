"""Operators 4, 7 and 10 against plain code written from their definitions, row by row; op2's files as files; op8's convergence."""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from llm_rows import SMALL, TEXTS, rows_by
from pyspark.sql import functions as F

from wordloom.llm import language_id, nn_descent, pu_quality, queries, token_files, transport_stream
from wordloom.llm.common import staged


# --- Language: expectation-maximisation by loops


def plain_language(model, text):
    """(language, score) by the definition: words of letters, byte trigrams, proportions, penalised sets."""
    data = b" " + (text or "").lower().encode() + b" "
    is_letter = lambda b: b > 127 or chr(b).isalpha()
    data = bytes(b if is_letter(b) else 32 for b in data)
    words, own = [], []
    for k in range(1, len(data) - 1):
        if data[k] == 32:
            if own:
                words.append(own)
            own = []
            continue
        code = (data[k - 1] * 0x9E3779B1 & 0xFFFFFFFF) ^ (data[k] * 0x85EBCA77 & 0xFFFFFFFF) ^ (data[k + 1] * 0xC2B2AE3D & 0xFFFFFFFF)
        own.append((code * 0x27D4EB2F & 0xFFFFFFFF) >> 16)
    words += [own] if own else []
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0
    like = [[float(sum(np.float32(model.table[k, c]) for c in w)) for k in range(len(model.languages))] for w in words]

    def maximise(allowed, rounds):
        share = {k: 1 / len(allowed) for k in allowed}
        value = 0.0
        for _ in range(rounds):
            sums, value = dict.fromkeys(allowed, 0.0), 0.0
            for row in like:
                top = max(row)
                joint = {k: math.exp(row[k] - top) * share[k] for k in allowed}
                total = max(sum(joint.values()), 1e-300)
                value += math.log(total) + top
                for k in allowed:
                    sums[k] += joint[k] / total
            share = {k: v / len(like) for k, v in sums.items()}
        return share, value

    full, _ = maximise(range(len(model.languages)), model.rounds)
    order = sorted(full, key=lambda k: (-full[k], k))
    best = max(((v - 0.5 * n * math.log(len(like)), -n, s) for n in range(1, len(order) + 1) for s, v in [maximise(order[:n], model.rounds if n > 1 else 1)]), key=lambda x: x[:2])[2]
    top = min(best, key=lambda k: (-best[k], k))
    return model.languages[top], min(1.0, best[top])


def test_languages_are_those_of_plain_loops(spark, small, odd):
    model = language_id.fit(small, language_id.remainder(F.col("doc_id"), 3) != 1)
    short = small.filter("n_chars < 700 or text is null").limit(60)
    for docs in (short, odd.filter("text is null or length(text) < 700")):
        got = language_id.predict(docs, model).collect()
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        want = [(i, *plain_language(model, t)) for i, t in texts.elements()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3


def test_more_than_six_languages_are_tried():
    """Ten languages of one letter each; a text of all ten has a set of ten."""
    names = [f"l{k}" for k in range(10)]
    texts = [chr(97 + k) * 4 for k in range(10)]
    table = np.full((10, language_id.BUCKETS), -12.0, dtype=np.float32)
    for k, t in enumerate(texts):
        table[k, language_id._codes([t])[0]] = -1.0
    shares, _ = language_id.infer(language_id.Model(names, table), [" ".join(texts * 30)])
    assert (shares[0] > 0).all() and np.allclose(shares[0], 0.1, atol=0.02)


# --- Quality: features by loops, scores by the model's own sum


def test_quality_features_and_scores_by_loops(spark, small, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = queries.quality_model(small, labels)
    for text in [t for _, t, *_ in TEXTS if t is None or len(t) < 3000][:12]:
        row = pu_quality.features([text or ""])[0]
        raw = (text or "").encode()
        pairs = Counter(int(pu_quality._SHAPE[a]) * pu_quality._SHAPES + int(pu_quality._SHAPE[b]) for a, b in zip(raw, raw[1:]))
        for k in range(pu_quality._SHAPES**2):
            assert abs(row[k] - math.sqrt(pairs[k] / max(1, len(raw) - 1))) < 1e-5
        z = sum(float((row[k] - model.mean[k]) / model.scale[k]) * float(model.weights[k]) for k in range(pu_quality.WIDTH)) + model.bias
        assert abs(float(model.score(row[None])[0]) - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-4


# --- Transport streams: packets taken apart one by one


def plain_payload(media):
    """The media stream's bytes by a packet loop, with each packet's continuity counter."""
    out, counters = [], []
    for at in range(0, len(media), 188):
        packet = media[at : at + 188]
        assert packet[0] == 0x47
        if (packet[1] & 0x1F) << 8 | packet[2] != transport_stream.MEDIA_PID:
            continue
        begin = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
        counters.append(packet[3] & 15)
        data = packet[begin:]
        if packet[1] & 0x40:
            assert data[:3] == b"\0\0\1"
            data = data[9 + data[8] :]
        out.append(data)
    return b"".join(out), counters


def test_streams_by_a_packet_loop(spark, small):
    stored = staged(transport_stream.with_media(small), "test-media")
    got = {r["doc_id"]: r for r in transport_stream.read_media(stored).collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in stored.limit(40).collect():
        payload, counters = plain_payload(bytes(r["media"]))
        assert payload == transport_stream.pad((texts[r["doc_id"]] or "").encode()) and counters == [k % 16 for k in range(len(counters))]
        own = got[r["doc_id"]]
        assert (own["payload_bytes"], own["tail_crc32"], own["media_bytes"]) == (len(payload), zlib.crc32(payload[-32:]), len(r["media"]))
    pat = next(bytes(r["media"])[:188] for r in stored.limit(1).collect())
    assert struct.unpack(">HH", pat[13:17]) == (1, 0xE000 | transport_stream.PMT_PID)


# --- Token files: row groups, encodings, page indexes, a few rows by their pages


def test_token_files_have_small_groups_pages_and_indexes(spark, tmp_path, small):
    path = token_files.write(small, f"file://{tmp_path}/ids", queries.tokenizer_path("word_bpe_49k.json"), row_group=64 << 10, page=4 << 10, shards=2)
    files = sorted((tmp_path / "ids").glob("*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index or column.path_in_schema.startswith("ids")
                assert column.compression == "ZSTD" and {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
    assert groups > len(files)
    ids = sorted(r["doc_id"] for r in token_files.read_index(spark, path).collect())
    asked = token_files.read_ids(spark, path).filter(F.col("doc_id").isin(ids[3], ids[-2]))
    assert "In(doc_id" in asked._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [In", "In(doc_id") or "doc_id IN" in asked._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in asked.collect()) == [ids[3], ids[-2]]


# --- NN-descent from drawn neighbours alone


def test_descent_finds_neighbours_without_the_blocks(spark):
    """3,000 vectors of very uneven lengths, each begun with neighbours drawn by a hash: the rounds end by themselves with most true neighbours found."""
    draw = np.random.default_rng(1)
    n, dim = 3000, 16
    x = draw.normal(size=(40, dim))[draw.integers(0, 40, n)] + 0.5 * draw.normal(size=(n, dim))
    x *= draw.lognormal(0, 1, size=(n, 1))
    packed = staged(spark.createDataFrame(list(zip(range(n), nn_descent.pack(x))), "id bigint, packed binary").repartition(4), "packed")
    draws = [nn_descent._drawn(packed, packed, dim, n, nn_descent.Plan(block=160), 4, salt) for salt in (77, 78, 79)]
    start = staged(nn_descent._best(draws[0].unionByName(draws[1]).unionByName(draws[2]), 40, 4), "start")
    graph = nn_descent.build_graph(packed, dim, n, nn_descent.Plan(), 4, start)
    y = nn_descent.unpack(nn_descent.pack(x), dim)
    hit = []
    for r in graph.filter("id % 50 = 0").collect():
        score = y @ y[r["id"]]
        score[r["id"]] = -np.inf
        hit.append(len(set(np.argpartition(-score, 20)[:20].tolist()) & set(np.frombuffer(r["ids"], "<i8").tolist())) / 20)
    assert np.mean(hit) > 0.9
    assert rows_by(graph.select(F.octet_length("ids").alias("n")).distinct().collect()) == rows_by([(8 * 40,)])
