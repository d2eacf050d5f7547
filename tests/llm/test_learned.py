"""Operators 4, 7 and 10: held-out accuracy, an exact round trip, and odd texts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from llm_rows import MEDIUM, TEXTS, rows_by
from pyspark.sql import functions as F

from wordloom.llm import language_id, pu_quality, queries, transport_stream
from wordloom.llm.transport_stream import MEDIA_PID, PACKET


# --- Language


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = queries.op4_language_mixture(spark, MEDIUM).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    return docs, language_id.fit(docs, language_id.remainder(F.col("doc_id"), 3) != 1)


def test_a_mixture_shows_both_its_languages(spark, languages):
    docs, model = languages
    texts = {r["lang"]: " ".join(r["text"].split()[:150]) for r in docs.filter("n_chars between 1200 and 3000").collect()}
    assert len(texts) >= 2
    a, b = sorted(texts)[:2]
    shares, _ = language_id.infer(model, [texts[a] + " " + texts[b], texts[a]])
    got = dict(zip(model.languages, shares[0]))
    assert abs(got[a] + got[b] - 1) < 0.15 and min(got[a], got[b]) > 0.3
    assert dict(zip(model.languages, shares[1]))[a] > 0.9


def test_languages_of_odd_texts(spark, odd, empty, languages):
    _, model = languages
    rows = language_id.predict(odd, model, proportions=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"], r["proportions"]) == ("und", 0.0, {})
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    assert language_id.predict(empty, model).collect() == []
    kept = language_id.keep(odd, model)
    assert kept.columns == odd.columns and {4, 5, 6}.isdisjoint(r["doc_id"] for r in kept.collect())
    nothing = language_id.fit(empty, language_id.remainder(F.col("doc_id"), 3) != 1)
    assert nothing.languages == [] and {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.keep(odd, nothing).collect() == []


def test_texts_with_marks_but_no_letters_are_unknown(spark, languages):
    docs = spark.createDataFrame([(1, "123 456 … — €"), (2, "ok")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.predict(docs, languages[1]).collect()} == {1: True, 2: False}


# --- Quality


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    positive = label == 1
    return (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def test_quality_of_held_out_documents(spark):
    got = queries.op10_quality(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert auc(np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])) > 0.85
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got.collect())


def test_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    held = language_id.remainder(F.col("doc_id"), 5) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = queries.quality_model(docs, labels), queries.quality_model(docs, turned)
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior


def test_quality_of_odd_texts(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.quality_model(docs, labels)
    rows = pu_quality.predict(odd, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert pu_quality.predict(empty, model).collect() == []
    unlearnt = queries.quality_model(empty, labels)
    assert {r["score"] for r in pu_quality.predict(odd, unlearnt).collect()} == {0.5}
    kept = pu_quality.keep(odd, model)
    assert kept.columns == odd.columns
    assert rows_by((r["doc_id"],) for r in kept.collect()) == rows_by((r["doc_id"],) for r in rows if r["predicted"])


def test_the_prior_is_near_the_true_share():
    draw = np.random.default_rng(2)
    positive = draw.normal(2, 1, 4000)
    for share in (0.2, 0.5, 0.8):
        n = int(8000 * share)
        mixed = np.concatenate([draw.normal(2, 1, n), draw.normal(-2, 1, 8000 - n)])
        assert abs(pu_quality.estimate_prior(positive, mixed) - share) < 0.08


def test_the_risk_never_runs_below_zero():
    """Few rows and many features: an unbiased risk would fall without end; weights stay bounded here."""
    draw = np.random.default_rng(4)
    w, b = pu_quality._descend(draw.normal(1, 1, (30, 200)).astype(np.float32), draw.normal(0, 1, (60, 200)).astype(np.float32), 0.5, 400)
    assert np.isfinite(w).all() and np.abs(w).max() < 10 and abs(b) < 10


# --- Transport streams


def test_streams_hold_the_texts(odd, empty, small, small_rows):
    for docs, rows in ((odd, [(i, t) for i, t, *_ in TEXTS]), (small, small_rows)):
        stored = transport_stream.with_media(docs)
        media = {}
        for r in stored.collect():
            media.setdefault((r["doc_id"], r["n_bytes"]), bytes(r["media"]))
        got = [r[:-1] + (r["feature"][:9],) for r in transport_stream.read_media(stored).collect()]
        want = []
        for doc_id, text in rows:
            raw = (text or "").encode()
            payload = transport_stream.pad(raw)
            own = media[doc_id, len(raw)]
            assert len(own) % PACKET == 0 and len(payload) % 576 == 0
            want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(own), hashlib.sha256(own).hexdigest(), "programs="))
        assert rows_by(got) == rows_by(want)
    assert transport_stream.read_media(transport_stream.with_media(empty)).collect() == []


@pytest.mark.parametrize("n", [1, 575, 576, 577, 9215, 9216, 9217, 73728, 73729, 300_000])
def test_round_trip_and_time(n):
    payload = transport_stream.pad(bytes(k * 7 % 256 for k in range(n)))
    media = transport_stream.mux(payload)
    found = transport_stream.demux(media)
    units = -(-len(payload) // transport_stream.ACCESS)
    assert found.payload == payload and found.continuity_errors == 0
    assert found.stamps == [k * transport_stream.STEP for k in range(units)]
    assert found.random_access == list(range(0, units, transport_stream.RANDOM_ACCESS_EVERY))
    assert found.programs == {1: 0x1000} and found.streams == {MEDIA_PID: 6}


def test_a_lost_packet_is_noticed():
    media = transport_stream.mux(transport_stream.pad(b"x" * 50_000))
    packets = [media[k : k + PACKET] for k in range(0, len(media), PACKET)]
    found = transport_stream.demux(b"".join(packets[:20] + packets[21:]))
    assert found.valid and found.continuity_errors == 1


def test_broken_streams_are_invalid(spark):
    media = transport_stream.mux(transport_stream.pad(b"text"))
    broken = bytearray(media)
    broken[10] ^= 1  # the program table's checksum no longer holds
    rows = [(1, 0, None), (2, 0, b""), (3, 0, b"x" * 100), (4, 0, bytes(broken)), (5, 4, media)]
    stored = spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")
    got = {r["doc_id"]: (r["feature"].split(";")[0], r["payload_bytes"]) for r in transport_stream.read_media(stored).collect()}
    assert got == {1: ("invalid", 0), 2: ("invalid", 0), 3: ("invalid", 0), 4: ("invalid", 0), 5: ("programs=1", 576)}


def test_sections_may_run_over_packets():
    """A program table with 90 streams in three packets, two sections in one packet, one broken section between."""
    body = transport_stream.struct.pack(">HH", 0xE000 | MEDIA_PID, 0xF000) + b"".join(transport_stream.struct.pack(">BHH", 6, 0xE000 | MEDIA_PID + k, 0xF000) for k in range(90))
    pmt = transport_stream._section(2, body)
    pat = transport_stream._section(0, transport_stream.struct.pack(">HH", 1, 0xE000 | transport_stream.PMT_PID))
    wrong = pat[:-1] + bytes([pat[-1] ^ 1])

    def packets(pid, raw, start=True):
        out, k = [], 0
        while raw or not k:
            head = b"\0" if start and not k else b""
            data, raw = raw[: 184 - len(head)], raw[184 - len(head) :]
            out.append((transport_stream.struct.pack(">BHB", 0x47, (0x4000 if head else 0) | pid, 0x10 | k & 15) + head + data).ljust(PACKET, b"\xff"))
            k += 1
        return out

    media = transport_stream.mux(transport_stream.pad(b"text"))
    own = [media[k : k + PACKET] for k in range(0, len(media), PACKET)][2:]
    found = transport_stream.demux(b"".join([*packets(0, wrong + pat), *packets(transport_stream.PMT_PID, pmt), *own]))
    assert len(packets(transport_stream.PMT_PID, pmt)) == 3
    assert found.valid and found.programs == {1: transport_stream.PMT_PID} and found.streams == {MEDIA_PID + k: 6 for k in range(90)} and found.payload == transport_stream.pad(b"text")
