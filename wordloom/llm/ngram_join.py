"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, linked exactly.

A document's words are runs of bytes other than ASCII white space, with A-Z in lower case; its set holds the distinct
runs of `words` words, or the whole text where it has fewer. Documents with equal words are one class, and a class
takes part once.

1. Shingles are hashed to 64 bits. Of its hashes in ascending order a class deals out the head only: as many as a partner
   may lack, and some more (head_length). Two classes that are linked share so many of their heads' hashes as `head_shared`
   says; classes that share fewer with all others have no partner and are out, and their texts are not read again.
2. The rest deal out all their shingles by hash in packed arrays; each bin counts in how many of these classes a shingle
   occurs. Those of one class only can be in no overlap, so only their number is kept. Shingles that are frequent (in
   LOCAL classes of the run that a task hands on at a time, or in FREQUENT of a bin) are not counted out: they come last
   in the rarest-first order, by hash. Their classes' entries mostly pass their bin by, and a bin holds few of them.
   The others go back to their classes, which order them rarest first. A class whose rarest-first prefix (as many
   shingles as a partner may lack, and one) holds no shared shingle has no partner and is out.
3. Classes meet on prefix shingles. Pairs must pass the length filter, the positional filter (what is left after the
   shingle in the rarest-first order must suffice) and the suffix filter: parities of shingles in 512 parts bound the
   sets' difference from below. Those that pass are verified exactly, once a pair.
4. In rounds, a shingle's classes stand in rings of about RING, in an order drawn anew, and each meets the two before it
   unless both are known to be of one component; components of all links found so far follow. A group of near copies
   thus grows together from few pairs, and no shingle's classes need be in one task. When a round finds little more, all
   pairs of different components meet: classes that are not of a shingle's commonest component meet all of its classes.

Nulls and texts without words have empty sets and are linked with nothing. Texts are taken whole; a very long one is
a step of its own. Rows with a null id have their component like others but never name it. Ids that repeat keep a row
each; an empty table gives no rows; other columns are not read. Hashes of 64 bits stand for shingles, made of words'
bytes (span_hash), and 128 bits of MD5 for texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scan_partitions, staged, text_steps
from .components import components
from .span_hash import mixed, word_hashes

NO_ID = -(1 << 63)
SIGNATURE_WORDS = 8
#: Bytes of a scan a bin; shingles that a task holds before it hands them on.
BIN_BYTES, HELD = 8 << 20, 800_000
#: Shingles of classes that are left over a bin.
BIN_SHINGLES = 1_300_000
#: Classes that make a shingle frequent: of one such run, and of a bin; entries that a bin holds before it looks for those.
LOCAL, FREQUENT, BIN_HELD = 32, 20_000, 2_000_000
#: Stands for the number of classes of a frequent shingle.
MANY = np.iinfo(np.int32).max
#: Classes of a ring, rounds of rings at most; a round that links less than this share of those left over is the last.
RING, ROUNDS, LEAST_SHARE = 256, 12, 0.02
_PLACE = mixed(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str], words: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(MD5 of the words, distinct hashes of the shingles) of each text."""
    normal = [b" ".join(t.encode().lower().split()) for t in texts]
    blob = b" ".join([*normal, b""])
    gaps = np.flatnonzero(np.frombuffer(blob, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], gaps[:-1] + 1]) if len(gaps) else gaps
    hashed = word_hashes(blob, starts, gaps)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in normal), dtype=np.int64, count=len(normal)))
    last = np.searchsorted(gaps, ends - 1) + 1
    run = hashed[: max(0, len(hashed) - words + 1)] * _PLACE[0]
    for k in range(1, words):
        run = run + hashed[k : k + len(run)] * _PLACE[k]
    run = mixed(run)
    first = 0
    for text, stop in zip(normal, last.tolist()):
        n = stop - first if text else 0
        if n >= words:
            own = np.unique(run[first : stop - words + 1])
        elif n:
            own = mixed((hashed[first:stop] * _PLACE[words : words + n]).sum(keepdims=True) + np.uint64(n))
        else:
            own = hashed[:0]
        yield hashlib.md5(text).digest(), own.view(np.int64)
        first = stop


def _least(n, pct: int):
    return (n * pct + 99) // 100


def _more(n, pct: int):
    return 1 + n * pct // 1000


def head_length(n, pct: int):
    """Of n hashes in ascending order how many are the head: those that a partner may lack, and some more."""
    return n - _least(n, pct) + _more(n, pct)


def head_shared(n, pct: int):
    """How many hashes of its head a set of n shares at least with a partner's head.

    Up to the k-th shared hash stand k - 1 shared ones and those that the partner lacks; so the heads of both hold the
    first k, for the less of their k's. A partner has at least _least(n) shingles.
    """
    return _more(_least(n, pct), pct)


def _dealt(bins: np.ndarray, columns: list[np.ndarray], names: list[str], empty: list[str]) -> pa.RecordBatch:
    """One row a bin with its share of each column as bytes."""
    order = np.argsort(bins, kind="stable")
    found, at = np.unique(bins[order], return_index=True)
    cuts = [*at.tolist(), len(bins)]
    arrays = [pa.array([c[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *arrays, *[pa.nulls(len(found), pa.binary())] * len(empty)], names=["bin", *names, *empty])


def _run_lengths(values: np.ndarray) -> np.ndarray:
    """How many equal values stand together, at each of them."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    length = np.diff(np.append(first, len(values)))
    return np.repeat(length, length)


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=kind)


_DOC = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("high", "<i8"), ("n", "<i4")])
_PACKED = "bin int, tokens binary, keys binary, ns binary, dfs binary, docs binary"



def _counted(docs: DataFrame, words: int, bins: int, head_pct: int = 0) -> DataFrame:
    """Packed rows by the bin of their class: entries of shared shingles. docs: text, id (bigint). head_pct: of classes' heads, with a row a document."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        sizes: list[int] = []
        keys: list[int] = []
        docs_seen: list[tuple] = []
        seen: set[bytes] = set()
        held = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            dealt = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
            token = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.int64)
            key, n = np.repeat(np.array(keys, dtype=np.int64), dealt), np.repeat(np.array(sizes, dtype=np.int32), dealt)
            if len(token):
                # Entries stay in the order of their classes, which lets the shuffle compress keys and sizes.
                order = np.argsort(token, kind="stable")
                run = token[order]
                often, first = np.zeros(len(token), dtype=bool), np.zeros(len(token), dtype=bool)
                often[order] = _run_lengths(run) >= LOCAL
                first[order] = np.append(True, run[1:] != run[:-1])
                # A frequent shingle's entries go to their classes; its bin gets one that says so.
                first &= often
                rest, none = np.concatenate([token[~often], token[first]]), np.zeros(int(first.sum()), dtype=np.int64)
                yield _dealt((rest.view(np.uint64) % np.uint64(bins)).astype(np.int32), [rest, np.append(key[~often], none), np.append(n[~often], none.astype(np.int32))], ["tokens", "keys", "ns"], ["dfs", "docs"])
                if often.any():
                    token, key, n = token[often], key[often], n[often]
                    yield _dealt((mixed(key.view(np.uint64)) % np.uint64(bins)).astype(np.int32), [token, key, n, np.full(len(n), MANY, dtype=np.int32)], ["tokens", "keys", "ns", "dfs"], ["docs"])
            if not head_pct:
                return
            rows = np.array(docs_seen, dtype=_DOC)
            yield pa.RecordBatch.from_arrays([pa.array((rows["doc_id"][:1] % bins).astype(np.int32)), *[pa.nulls(1, pa.binary())] * 4, pa.array([rows.tobytes()], pa.binary())], names=["bin", "tokens", "keys", "ns", "dfs", "docs"])

        for part, texts in text_steps(batches):
            ids = part.column(1).fill_null(NO_ID).to_pylist()
            for doc_id, (md5, own) in zip(ids, shingle_sets(texts, words)):
                key, high = np.frombuffer(md5, dtype="<i8").tolist()
                docs_seen.append((doc_id, key, high, len(own)))
                if md5 not in seen and len(own):
                    seen.add(md5)
                    tokens.append(own[: head_length(len(own), head_pct)] if head_pct else own)
                    sizes.append(len(own))
                    keys.append(key)
                    held += len(tokens[-1])
            if held >= HELD or len(docs_seen) >= HELD // 10:
                yield from handed_on()
                tokens, sizes, keys, docs_seen, seen, held = [], [], [], [], set(), 0
        if docs_seen:
            yield from handed_on()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with their shingle's number of classes. Entries of size 0 say that a shingle is frequent."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        frequent = np.empty(0, dtype=np.int64)
        total = 0

        def gathered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """All entries held by shingle and class, each once; frequent ones last of a shingle's."""
            token, key, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((n == 0, key, token))
            token, key, n = token[order], key[order], n[order]
            fresh = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (n[1:] == 0))[: len(token)]
            return token[fresh], key[fresh], n[fresh]

        def to_classes(token: np.ndarray, key: np.ndarray, n: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(token):
                order = np.argsort(key, kind="stable")
                token, key, n, df = token[order], key[order], n[order], df[order]
                yield _dealt((mixed(key.view(np.uint64)) % np.uint64(bins)).astype(np.int32), [token, key, n, df], ["tokens", "keys", "ns", "dfs"], ["docs"])

        for batch in batches:
            passing = pa.compute.or_(batch.column(4).is_valid(), batch.column(5).is_valid())
            if (rest := batch.filter(passing)).num_rows:
                yield rest
            own = batch.filter(pa.compute.invert(passing))
            if own.num_rows:
                held.append(tuple(_joined(own.column(c), kind) for c, kind in ((1, "<i8"), (2, "<i8"), (3, "<i4"))))
                total += len(held[-1][0])
            if total > BIN_HELD:
                token, key, n = gathered()
                many = np.unique(token[(_run_lengths(token) > FREQUENT) | (n == 0)])
                frequent = np.union1d(frequent, many)
                now = np.isin(token, frequent)
                real = now & (n > 0)
                yield from to_classes(token[real], key[real], n[real], np.full(int(real.sum()), MANY, dtype=np.int32))
                held = [(token[~now], key[~now], n[~now])]
                total = len(held[0][0]) // 2  # distinct shingles may fill a bin: then look again when as many have come
        if not held:
            return
        token, key, n = gathered()
        df = _run_lengths(token).astype(np.int32)
        df[np.isin(token, np.union1d(frequent, token[n == 0]))] = MANY
        shared = (df > 1) & (n > 0)
        yield from to_classes(token[shared], key[shared], n[shared], df[shared])

    dealt = docs.mapInArrow(shingles, _PACKED).repartitionById(bins, "bin")
    return dealt.mapInArrow(frequencies, _PACKED).repartitionById(bins, "bin")


def _entries(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, key, n, df) by class, in the order of (df, token), each once: copies of one text in several tasks send a frequent shingle more than once."""
    token, key, n, df = (np.concatenate(p) if p else np.empty(0, dtype=np.int64) for p in parts)
    order = np.lexsort((token, df, key))
    token, key, n, df = token[order], key[order], n[order], df[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (token[1:] != token[:-1]))[: len(token)]
    return token[fresh], key[fresh], n[fresh], df[fresh]


def _columns(batch: pa.RecordBatch, parts: list[list[np.ndarray]]) -> None:
    for own, column, kind in zip(parts, (1, 2, 3, 4), ("<i8", "<i8", "<i4", "<i4")):
        own.append(_joined(batch.column(column), kind))


def _documents(docs: DataFrame, words: int, pct: int, bins: int) -> DataFrame:
    """kind 0: (doc_id, key, high, n) of each document; kind 1: (key, n) of classes that may have partners by their heads."""
    names = ["kind", "doc_id", "key", "high", "n"]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            _columns(batch, parts)
            rows = _joined(batch.column(5), _DOC)
            if len(rows):
                ids = rows["doc_id"].copy()
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), dtype=np.int8)), pa.array(ids, mask=ids == NO_ID), *(pa.array(rows[c].copy()) for c in ("key", "high", "n"))], names=names)
        _, key, n, _ = _entries(parts)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        shared, key, n = np.diff(np.append(first, len(key))), key[first], n[first]
        kept = shared >= head_shared(n.astype(np.int64), pct)
        key, n = key[kept], n[kept].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), dtype=np.int8)), pa.nulls(len(key), pa.int64()), pa.array(key), pa.nulls(len(key), pa.int64()), pa.array(n)], names=names)

    return staged(_counted(docs, words, bins, pct).mapInArrow(heads, "kind tinyint, doc_id bigint, key bigint, high bigint, n int"), "documents", ["kind"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(text, id, key): of equal texts in a task one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, texts in text_steps(batches):
            keys = [int.from_bytes(hashlib.md5(b" ".join(t.encode().lower().split())).digest()[:8], "little", signed=True) for t in texts]
            fresh = []
            for k in keys:
                fresh.append(k not in seen)
                seen.add(k)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=["text", "id", "key"]).filter(pa.array(fresh, pa.bool_()))

    return docs.mapInArrow(add, "text string, id bigint, key bigint")


def _profiles(docs: DataFrame, words: int, pct: int, bins: int) -> DataFrame:
    """(key, n, m, tokens, prefix, s0..) of classes that may have partners. docs: text, id of such classes."""
    names = ["key", "n", "m", "tokens", "prefix", *(f"s{k}" for k in range(SIGNATURE_WORDS))]

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            _columns(batch, parts)
        token, key, n, _ = _entries(parts)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        m = np.diff(np.append(first, len(key)))
        size = n[first].astype(np.int64)
        in_prefix = m - _least(size, pct) + 1
        out = []
        for a, count, total, prefix in zip(first.tolist(), m.tolist(), size.tolist(), in_prefix.tolist()):
            if prefix < 1:
                continue
            own = token[a : a + count]
            odd = np.bincount((own.view(np.uint64) >> np.uint64(7) & np.uint64(64 * SIGNATURE_WORDS - 1)).astype(np.int64), minlength=64 * SIGNATURE_WORDS) & 1
            signature = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
            out.append((int(key[a]), total, count, own.tobytes(), own[:prefix].tolist(), *signature))
            if len(out) == 1000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * SIGNATURE_WORDS]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "key bigint, n int, m int, tokens binary, prefix array<bigint>, " + ", ".join(f"s{k} bigint" for k in range(SIGNATURE_WORDS))
    return staged(_counted(docs, words, bins).mapInArrow(classes, schema), "shingles")


def _fits(pct: int) -> Column:
    """The length, positional and suffix filters on a row of two prefix entries a and b."""
    need = F.ceil((F.col("a.n") + F.col("b.n")) * pct / (100 + pct)).cast("bigint")
    length = (F.greatest("a.n", "b.n") * pct <= F.least("a.n", "b.n") * 100) & (F.least("a.m", "b.m") >= need)
    position = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= need
    apart = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(SIGNATURE_WORDS)), F.lit(0))
    # Shingles of one class only are in the difference as well.
    alone = F.col("a.n") - F.col("a.m") + F.col("b.n") - F.col("b.m")
    return length & position & (apart + alone <= F.col("a.n") + F.col("b.n") - 2 * need)


def _verified(pairs: DataFrame, profiles: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            keep = []
            for x, y, total in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                both = np.concatenate([np.frombuffer(x, dtype="<i8"), np.frombuffer(y, dtype="<i8")])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= pct * (total - shared))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    side = lambda c: profiles.select(F.col("key").alias(c), F.col("tokens").alias(f"{c}_tokens"), F.col("n").alias(f"{c}_n"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_tokens", "b_tokens", (F.col("a_n") + F.col("b_n")).alias("total"))
    return full.mapInArrow(verify, "a bigint, b bigint")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def _ring_pairs(entries: DataFrame, fields: list[str], turn: int, pct: int) -> DataFrame:
    """(a, b): each entry with the two before it in its ring, where they may be linked and are of two components."""
    ring = F.pmod(F.xxhash64("key", "token", F.lit(2 * turn)), F.ceil(F.col("c") / RING))
    placed = entries.select("token", F.struct(*fields).alias("e"), ring.alias("ring"), F.xxhash64("key", "token", F.lit(2 * turn + 1)).alias("h"))
    order = Window.partitionBy("token", "ring").orderBy("h", F.col("e.key"))
    before = placed.select("e", F.array(F.lag("e", 1).over(order), F.lag("e", 2).over(order)).alias("before"))
    met = before.select("e", F.explode("before").alias("f")).filter(F.col("f").isNotNull())
    return _pairs(met.select(F.col("e").alias("a"), F.col("f").alias("b")).filter((F.col("a.component") != F.col("b.component")) & _fits(pct)))


def _linked_classes(profiles: DataFrame, pct: int) -> DataFrame:
    """(u, component) of every class with links that is not its component's least."""
    signature = [f"s{k}" for k in range(SIGNATURE_WORDS)]
    fields = ["key", "n", "m", "pos", *signature, "component"]
    entries = profiles.select("key", "n", "m", *signature, F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("n") - F.col("m"))
    sizes = staged(entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "sizes")
    entries = staged(entries.join(sizes, "token"), "entries")
    labels, mixed_entries, turn = None, entries.withColumn("component", F.col("key")), 0
    while True:
        more = staged(_verified(_ring_pairs(mixed_entries, fields, turn, pct), profiles, pct), "links")
        found, turn = more.count(), turn + 1
        if found:
            labels = components(more if labels is None else more.unionByName(labels.select(F.col("u").alias("a"), F.col("component").alias("b"))))
        # What is left: classes of shingles that two components share.
        own = entries.withColumn("component", F.col("key")) if labels is None else entries.join(labels.withColumnRenamed("u", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        counted = own.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
        common = counted.groupBy("token").agg(F.max(F.struct("k", "component")).alias("x"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        common = staged(common.select("token", F.col("x.component").alias("common")), "common")
        mixed_entries = staged(own.join(common, "token"), "mixed")
        left = mixed_entries.filter("component <> common").count()
        if not left:
            return labels if labels is not None else components(more)
        if found < LEAST_SHARE * left or turn == ROUNDS:
            break
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.common")) | (F.col("a.key") < F.col("b.key")))
    rest = mixed_entries.filter("component <> common").alias("a").join(mixed_entries.alias("b"), meet & _fits(pct))
    more = _verified(_pairs(rest), profiles, pct)
    return components(more if labels is None else more.unionByName(labels.select(F.col("u").alias("a"), F.col("component").alias("b"))))


def linked_components(docs: DataFrame, words: int = 5, pct: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document: component_id is the least id that links reach from it."""
    if not 1 <= words <= 128 or not 1 <= pct <= 100:
        raise ValueError("words from 1 to 128, pct from 1 to 100")
    texts = docs.select(F.col(text_column).alias("text"), F.col(id_column).cast("bigint").alias("id"))
    # About 8 MB of the scan a bin, 16 MB of heads. Few bins keep a class's entries together, which the shuffle compresses.
    split = docs.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = scan_partitions(docs)
    table = _documents(texts, words, pct, max(1, split // (2 * BIN_BYTES)) * parts)
    candidates = table.filter("kind = 1")
    bins = max(parts, (candidates.agg(F.sum("n")).first()[0] or 0) // BIN_SHINGLES)
    left = _keyed(texts).join(candidates.select("key"), "key", "left_semi").select("text", "id")
    members = table.filter("kind = 0").select("doc_id", "key", "high", F.col("n").cast("bigint").alias("n_shingles"))
    near = _linked_classes(_profiles(left, words, pct, bins), pct)

    # Every class in a link, by its component; a component's least class is in no row of near.
    inside = near.select(F.col("u").alias("key"), "component").unionByName(near.select(F.col("component").alias("key"), "component").distinct())
    first = members.filter("n_shingles > 0").groupBy("key", "high").agg(F.min("doc_id").alias("class_id"))
    named = first.join(inside, "key").groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = inside.join(named, "component").select("key", "component_id")
    classes = first.join(named, "key", "left").select(F.col("key").alias("k"), F.col("high").alias("h"), F.coalesce("component_id", "class_id").alias("component_id"))
    filled = members.join(classes, (F.col("key") == F.col("k")) & (F.col("high") == F.col("h")), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return filled.select(F.col("doc_id").alias(id_column), "n_shingles", own.alias("component_id"))
