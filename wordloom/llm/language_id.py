"""Language ID by mixture inference: each text's language proportions, over the set of languages that pays for itself.

Each language has a table of log-likelihoods of hashed byte trigrams around a letter. A word's log-likelihood in a
language is the sum over its letters. A text is a mixture: expectation-maximisation over its words estimates the
languages' proportions. With all languages in play they are ranked by proportion; then sets of the first one, two, .. up to
all languages are fitted again, and the set with the highest penalised log-likelihood (half the logarithm of the number of
words for each language) is the text's. The prediction is the set's largest proportion, ties to the smaller name.

The tables are fitted on a bounded sample of labelled rows (`fit_rows`, by a hash of the id) and hold `BUCKETS` numbers
a language. Text is the only input of a prediction. Null texts and texts without a letter give 'und' with score 0 and
no proportions; rows with a null id take no part in learning and count as not held out. Without labelled rows all
predictions are 'und'. Texts are taken whole, however long. Repeated rows and empty tables give as many rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_steps

BUCKETS = 1 << 16
UNKNOWN = "und"
SPACE = 32
#: Letters of a byte alphabet: ASCII letters and every byte of other characters.
_LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages x BUCKETS, log-likelihoods
    rounds: int = 12


def remainder(id_column: Column, of: int) -> Column:
    return F.crc32(id_column.cast("string")) % of


def fit_share(id_column: Column, rows: int, total: int) -> Column:
    """True for about `rows` of `total` rows, by a hash of the id."""
    return F.crc32(F.concat(F.lit("fit/"), id_column.cast("string"))) < F.lit(int(min(1.0, rows / max(total, 1)) * 2**32))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all letters in a row, the starts of words in them, and how many words each text has."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
    data = np.where(_LETTER[data], data, np.uint8(SPACE))
    at = np.flatnonzero(data != SPACE)
    wide = data.astype(np.uint32)
    code = ((wide[at - 1] * np.uint32(0x9E3779B1)) ^ (wide[at] * np.uint32(0x85EBCA77)) ^ (wide[at + 1] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    words = np.flatnonzero(np.diff(at, prepend=-1) != 1)
    stops = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1)
    counts = np.diff(np.searchsorted(at[words], stops), prepend=0)
    return code.astype(np.int64), words, counts


def fit(docs: DataFrame, is_train: Column, fit_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Tables from rows with is_train, a language and a text; about fit_rows of them at most."""
    labelled = docs.filter(is_train & F.col(lang_column).isNotNull())
    total = labelled.count()
    sample = labelled.filter(fit_share(F.col(id_column), fit_rows, total)).select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in text_steps(batches):
            by: dict[str, list[str]] = {}
            for text, lang in zip(texts, part.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                sums[lang] = sums.get(lang, 0) + np.bincount(_codes(own)[0], minlength=BUCKETS)
        for lang, n in sums.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], names=["lang", "bucket", "n"])

    # At most BUCKETS rows a language.
    counted = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counted["lang"]))
    n = np.zeros((len(languages), BUCKETS))
    n[counted["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=int), counted["bucket"].to_numpy(dtype=int)] = counted["n"].to_numpy()
    used = max(1, int((n.sum(axis=0) > 0).sum()))
    table = np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * used))
    return Model(languages, table.astype(np.float32))


def _maximise(word_ll: np.ndarray, first: np.ndarray, counts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of texts of counts[k] > 0 words each, with the allowed languages of each."""
    top = word_ll.max(axis=1, keepdims=True)
    like = np.exp(word_ll - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = like * np.repeat(share, counts, axis=0)
        total = joint.sum(axis=1, keepdims=True)
        np.maximum(total, 1e-300, out=total)
        share = np.add.reduceat(joint / total, first, axis=0) / counts[:, None]
    return share, np.add.reduceat(np.log(total[:, 0]) + top[:, 0], first)


def infer(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, whether the text has words) of each text."""
    code, words, counts = _codes(texts)
    shares = np.zeros((len(texts), len(model.languages)))
    has = counts > 0
    if not has.any() or not model.languages:
        return shares, np.zeros(len(texts), dtype=bool)
    own = counts[has]
    first = np.cumsum(own) - own
    ll = np.add.reduceat(model.table[:, code], words, axis=1).T.astype(np.float64)
    everything = np.ones((len(own), len(model.languages)))
    full, _ = _maximise(ll, first, own, everything, model.rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(len(own), -np.inf), np.zeros_like(full)
    for size in range(1, len(model.languages) + 1):
        share, value = _maximise(ll, first, own, (rank < size).astype(float), model.rounds if size > 1 else 1)
        value = value - 0.5 * size * np.log(own)
        better = value > best
        best[better], chosen[better] = value[better], share[better]
    shares[has] = chosen
    return shares, has


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", proportions: bool = False) -> DataFrame:
    """(id, lang_pred, score), with proportions also a map of the chosen languages to their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for part, texts in text_steps(batches):
            shares, has = infer(model, texts)
            known = [bool(h and letter.search(t)) for h, t in zip(has, texts)]
            best = shares.argmax(axis=1) if model.languages else np.zeros(len(texts), dtype=int)
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = [min(1.0, float(s[b])) if k else 0.0 for s, b, k in zip(shares, best, known)]
            columns = [part.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())]
            if proportions:
                columns.append(pa.array([[(x, float(p)) for x, p in zip(model.languages, s) if p > 0] if k else [] for s, k in zip(shares, known)], pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "lang_pred", "score"] + ["proportions"] * proportions)

    kind = dict(docs.dtypes)[id_column]
    return docs.select(text_column, id_column).mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double" + ", proportions map<string,double>" * proportions)


def keep(docs: DataFrame, model: Model, least_share: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose texts have letters and a language with at least that share of the words."""
    columns = [text_column, *(c for c in docs.columns if c != text_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for part, texts in text_steps(batches):
            shares, has = infer(model, texts)
            top = shares.max(axis=1, initial=0)
            yield part.filter(pa.array([bool(h and s >= least_share and letter.search(t)) for h, s, t in zip(has, top, texts)], pa.bool_()))

    ordered = docs.select(*columns)
    return ordered.mapInArrow(run, ordered.schema).select(*docs.columns)
