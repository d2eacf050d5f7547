"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Tokens are words (A-Z lower-cased, cut at ASCII white space) and one end a text. Each word, and the start of a text, is a
restaurant whose dishes are the tokens that follow it; all these restaurants share one parent, over single tokens, whose
own parent is uniform over the known tokens and one unknown. A table in a restaurant sends one customer to the parent.

Seating is sampled by Gibbs, and in each sweep all customers leave and sit down anew. A restaurant's gamma variable (of
strength / discount + its tables) makes its dishes independent of each other: a dish's tables then weigh weight^tables x
the product of (1 - discount)(2 - discount).. over their sizes, where weight is discount x the variable x the parent's
probability. Tables take colours at random, which part a dish's customers into groups of a small weight each. A group is
seated as in a restaurant of its own, table by table (a beta share and a binomial number of those left), and that seating
is taken or not by Metropolis and Hastings. So a sweep costs by tables, not by customers. Dishes of one customer have one
table always and are only counted. Rounds go between the levels: the parent is seated with the restaurants' tables as
customers, its averaged probabilities go to the restaurants, and those seat theirs. A text's score is the sum over its
tokens of log10 of the predictive probability, averaged over samples.

Work is dealt by word pairs, never by documents: chunks of bounded text count their pairs first, then send them packed to
the bucket of the first word; a word of over a quarter of a bucket's share (found in a sample, which decides the dealing
only) is dealt by the pair, and its sums are added up over buckets. A pair of over a quarter of a bucket's share of
entries gets its probability before the texts are scored and is added up in its chunks. A second pass over the texts
sends, with each pair, the documents that hold it, and gets back sums by document. First words travel as bytes, second
words as 64 bits of XXH3: counts of single tokens are exact, and two of some 10^10 words may share a dish.

Null and empty texts are an end only. Null ids are scored and not learnt from. Repeated rows all count. Without rows to
learn from every token is unknown and as likely as any. Texts are taken whole; one longer than a chunk is a chunk. An empty table gives no
rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .span_hash import mixed

#: Stands for the start as first word and for the end as second; no word holds white space.
EDGE = b"\n"
CHUNK_BYTES, CHUNK_DOCS = 16_000_000, 60_000
#: Bytes of text whose pairs one bucket gets.
BUCKET_BYTES = 14_000_000
#: One document in so many is read to find words and pairs that must be split.
SAMPLE_OF = 16
#: A group of tables that are seated anew together has at most this weight, or about so many customers where that is more.
GROUP_WEIGHT, GROUP_CUSTOMERS = 0.5, 4
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    strength: float = 1.0
    parent_strength: float = 1.0
    parent_discount: float = 0.75
    rounds: int = 1
    burn_in: int = 2
    samples: int = 3
    seed: int = 7


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def pack(values: np.ndarray) -> bytes:
    """Numbers of 0 or more in as few bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series for x > 0, begun at x + 8."""
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / y**2) / y**2) / y - np.log(product)


def _likely_tables(customers: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """About how many tables customers take where a new one weighs so much, by the saddle point of the tables' generating function."""
    others = customers - 1
    high = -np.log1p(others / weight)
    low = high / (1 - discount)
    for _ in range(6):
        y = np.exp((low + high) / 2)
        above = weight * (1 - y) * y ** (discount - 1) > others
        low, high = np.where(above, np.log(y), low), np.where(above, high, np.log(y))
    return 1 + weight / discount * -np.expm1(discount * (low + high) / 2)


class Seating:
    """Tables of dishes of two customers or more. rest: each dish's restaurant."""

    def __init__(self, customers: np.ndarray, rest: np.ndarray, tables_of: np.ndarray, chance: np.ndarray, discount: float, strength: float, rng: np.random.Generator):
        """tables_of: each restaurant's tables, these dishes' excluded. chance: the parent's probability of each dish."""
        self.customers, self.rest, self.chance, self.discount, self.strength, self.rng = customers, rest, chance, discount, strength, rng
        self.restaurants = len(tables_of)
        self.tables = np.ones(len(customers), dtype=np.int64)
        for _ in range(2):
            weight = (strength + discount * (tables_of + self._by_rest(self.tables)))[rest] * chance
            self.tables = np.clip(np.round(_likely_tables(customers, weight, discount)), 1, customers).astype(np.int64)
        self.all_tables = tables_of + self._by_rest(self.tables)
        self.dish = np.repeat(np.arange(len(customers)), self.tables)
        most = 1 + ((customers - self.tables) // self.tables)[self.dish]
        self.size = np.minimum(rng.geometric(np.maximum(rng.beta(discount, 1 - discount, len(self.dish)), 1e-12)), most)
        # A dish's first table has all that the others leave.
        first = np.cumsum(self.tables) - self.tables
        self.size[first] = 0
        self.size[first] = customers - self._by_dish(self.size)

    def _by_rest(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.rest, weights=values, minlength=self.restaurants).astype(np.int64)

    def _by_dish(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.dish, weights=values, minlength=len(self.customers)).astype(np.int64)

    def _drawn(self, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables for groups of n customers where a new table weighs `own`: each one's group and size; and the proposal's strength and discount."""
        d = self.discount
        # Leans to few tables where there may be many. How far is a matter of speed only, as the size of groups is.
        tilt = own / (1 + d * np.log(np.minimum(np.maximum(n - 1, 1), 1 + n / own)) * np.minimum(1, own / GROUP_WEIGHT))
        left, open_, groups, sizes = n.copy(), np.arange(len(n)), [], []
        while len(open_):
            share = self.rng.beta(1 - d, tilt[open_] + d * len(sizes))
            groups.append(open_)
            sizes.append(1 + self.rng.binomial(left[open_] - 1, share))
            left[open_] -= sizes[-1]
            open_ = open_[left[open_] > 0]
        return np.concatenate([*groups, open_]), np.concatenate([*sizes, open_]), tilt

    def step(self, dishes: np.ndarray) -> None:
        """All customers of the dishes leave and sit down anew, one group of tables at a time."""
        rng, d = self.rng, self.discount
        weight = d * rng.standard_gamma(self.strength / d + self.all_tables)[self.rest] * self.chance
        colours = np.ceil(np.minimum(weight / GROUP_WEIGHT, self.customers / GROUP_CUSTOMERS)).astype(np.int64)
        moving = np.zeros(len(self.customers), dtype=bool)
        moving[dishes] = True
        going = np.flatnonzero(moving[self.dish])
        of = self.dish[going]
        colour = (rng.random(len(of)) * colours[of]).astype(np.int64)
        order = np.lexsort((colour, of))
        going, of, colour = going[order], of[order], colour[order]
        starts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (colour[1:] != colour[:-1]))[: len(of)])
        if not len(starts):
            return
        dish, seated = of[starts], np.diff(np.append(starts, len(of)))
        own = (weight / colours)[dish]
        group, size, tilt = self._drawn(np.add.reduceat(self.size[going], starts), own)
        fresh = np.bincount(group, minlength=len(starts))
        ratio = (fresh - seated) * np.log(own / d) + _log_gamma(tilt / d + seated - 1) - _log_gamma(tilt / d + fresh - 1)
        taken = np.log1p(-rng.random(len(starts))) < ratio
        kept = np.ones(len(self.dish), dtype=bool)
        kept[going] = ~np.repeat(taken, seated)
        new = taken[group]
        self.dish, self.size = np.concatenate([self.dish[kept], dish[group[new]]]), np.concatenate([self.size[kept], size[new]])
        order = np.argsort(self.dish, kind="stable")
        self.dish, self.size = self.dish[order], self.size[order]
        before, self.tables = self.tables, np.bincount(self.dish, minlength=len(self.customers))
        self.all_tables = self.all_tables + self._by_rest(self.tables - before)

    def sample(self, settings: Settings) -> np.ndarray:
        """Mean tables of each dish over the samples."""
        total = np.zeros(len(self.customers))
        for sweep in range(settings.burn_in + settings.samples):
            self.step(np.arange(len(self.customers)))
            if sweep >= settings.burn_in:
                total += self.tables
        return total / settings.samples


@dataclass(frozen=True)
class Dealing:
    buckets: int
    hot_words: tuple[bytes, ...]
    hot_pairs: tuple[tuple[bytes, bytes], ...]

    @property
    def shards(self) -> int:
        """Parts of the parent's dishes, by the first bits of their hashes."""
        return -(-self.buckets // 4)

    def shard_edges(self) -> np.ndarray:
        return np.array([(k << 64) // self.shards for k in range(1, self.shards)], dtype=np.uint64)


class _Chunk:
    """Texts of a bounded size as numbers of words; 0 stands for the edges."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {EDGE: 0}
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []
        self.bytes = self.docs = 0

    def add(self, row: pa.RecordBatch, texts: pa.Array) -> None:
        found, sizes = [], []
        for text in texts.to_pylist():
            own = tokens(text)
            sizes.append(len(own))
            found += own
        coded = pa.array(found, pa.binary()).dictionary_encode()
        places = np.fromiter((self.places.setdefault(w, len(self.places)) for w in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        self.codes.append(places[coded.indices.to_numpy()].astype(np.int32))
        self.sizes.append(np.array(sizes, dtype=np.int64))
        self.rows.append(row)
        self.bytes += int(pa.compute.sum(pa.compute.binary_length(texts)).as_py() or 0)
        self.docs += len(sizes)

    def close(self) -> None:
        codes, sizes = np.concatenate(self.codes), np.concatenate(self.sizes)
        self.info = pa.Table.from_batches(self.rows)
        self.train = self.info.column(2).to_numpy(zero_copy_only=False).astype(bool)
        self.n_tokens = sizes + 1
        ends = np.cumsum(self.n_tokens)
        inner = np.ones(int(ends[-1]), dtype=bool)
        inner[ends - self.n_tokens] = False
        self.first = np.zeros(len(inner), dtype=np.int32)
        self.first[inner] = codes
        self.second = np.append(self.first[1:], np.int32(0))
        self.doc = np.repeat(np.arange(self.docs, dtype=np.int32), self.n_tokens)
        self.codes = []
        self.words = list(self.places)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=len(self.words))

    def pair_keys(self) -> np.ndarray:
        key = self.first.astype(np.int64)
        key *= len(self.words)
        key += self.second
        return key

    def codes_of(self, words: tuple[bytes, ...]) -> np.ndarray:
        return np.array([self.places[w] for w in words if w in self.places], dtype=np.int64)

    def buckets(self, first: np.ndarray, second: np.ndarray, deal: Dealing) -> np.ndarray:
        hot = np.zeros(len(self.words), dtype=bool)
        hot[self.codes_of(deal.hot_words)] = True
        h = self.hashes[first]
        return (np.where(hot[first], mixed(h ^ self.hashes[second] * _ODD), h) % np.uint64(deal.buckets)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Columns: text, id, train, held_out."""
    own = _Chunk()
    for batch in batches:
        texts = pa.compute.fill_null(batch.column(0).cast(pa.binary()), b"")
        sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(sizes, done + 1_000_000, side="right")))
            own.add(batch.select(["id", "held_out", "train"]).slice(at, end - at), texts.slice(at, end - at))
            at, done = end, int(sizes[end - 1])
            if own.bytes >= CHUNK_BYTES or own.docs >= CHUNK_DOCS:
                own.close()
                yield own
                own = _Chunk()
    if own.docs:
        own.close()
        yield own


def _runs(key: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new)


def _blocks(chunk: _Chunk, first: np.ndarray, second: np.ndarray, deal: Dealing) -> Iterator[tuple[int, np.ndarray, dict[str, bytes]]]:
    """Of pairs in ascending order: each bucket, its pairs and their names packed."""
    bucket = chunk.buckets(first, second, deal)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(deal.buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[b] : edges[b + 1]]
        starts = _runs(first[own])
        heads, tails = np.unique(second[own], return_inverse=True)
        names = b" ".join([chunk.words[k] for k in first[own][starts].tolist()])
        yield b, own, {"names": names, "fan": pack(np.diff(np.append(starts, len(own)))), "heads": chunk.hashes[heads].tobytes(), "tails": pack(tails)}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


class Merged:
    """A bucket's pairs from all blocks, in the order of first words' bytes and second words' hashes."""

    def __init__(self, table: pa.Table, hot_words: tuple[bytes, ...]):
        names = [x.split(b" ") for x in table["names"].to_pylist()]
        fans = [unpack(x) for x in table["fan"].to_pylist()]
        coded = pa.array([w for x in names for w in x], pa.binary()).dictionary_encode()
        order = pa.compute.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.words = coded.dictionary.take(pa.array(order)).to_pylist()
        hot = {w: k for k, w in enumerate(hot_words)}
        #: Each first word's place among the hot words, or -1.
        self.hot = np.fromiter((hot.get(w, -1) for w in self.words), dtype=np.int64, count=len(self.words))
        first = np.repeat(place[coded.indices.to_numpy()], np.concatenate(fans))
        heads = [np.frombuffer(x, dtype=np.uint64) for x in table["heads"].to_pylist()]
        #: Hashes of all second words.
        self.heads, own = np.unique(np.concatenate(heads), return_inverse=True)
        offsets = np.cumsum([0, *map(len, heads[:-1])])
        tails = [unpack(x) for x in table["tails"].to_pylist()]
        self.block_pairs = np.array([len(x) for x in tails])
        second = own[np.concatenate([x + o for x, o in zip(tails, offsets)])]
        key = first * len(self.heads) + second
        self.order = np.argsort(key, kind="stable")
        self.starts = _runs(key[self.order])
        self.first, self.second = first[self.order][self.starts], second[self.order][self.starts]

    def pair_of(self) -> np.ndarray:
        """The pair of each block's pair, in the order of blocks."""
        out = np.empty(len(self.order), dtype=np.int64)
        marks = np.zeros(len(self.order), dtype=np.int64)
        marks[self.starts] = 1
        out[self.order] = np.cumsum(marks) - 1
        return out

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.first, weights=values, minlength=len(self.words))


def _bucket_totals(n: np.ndarray, merged: Merged, hot_pairs: dict[tuple[bytes, int], int]) -> dict:
    """A bucket's row after counting: n customers of each pair. split: six numbers a pair that is split."""
    many = n > 1
    split: list[int] = []
    if hot_pairs:
        firsts = {w for w, _ in hot_pairs}
        of_many = np.where(many, np.cumsum(many) - 1, -1)
        for k in np.flatnonzero(np.isin(merged.first, [k for k, w in enumerate(merged.words) if w in firsts])).tolist():
            a, b = int(merged.first[k]), int(merged.second[k])
            if (pair := hot_pairs.get((merged.words[a], int(merged.heads[b])))) is not None:
                split += [pair, int(n[k]), int(n[merged.first == a].sum()), a, b, int(of_many[k])]
    of_word = merged.by_word(n).astype(np.int64)
    ones = merged.by_word(n == 1).astype(np.int64)
    hot = np.flatnonzero(merged.hot >= 0)
    tables = merged.by_word(n > 0).astype(np.int64)
    return {
        "heads": merged.heads.tobytes(),
        "customers": pack(np.bincount(merged.second[n > 0], minlength=len(merged.heads))),
        "singles": pack(np.bincount(merged.second[n == 1], minlength=len(merged.heads))),
        "word_singles": pack(ones), "hot_words": (merged.hot + 1).astype(np.int32).tobytes(),
        "first": pack(merged.first[many]), "second": pack(merged.second[many]), "n": pack(n[many]),
        "pairs": int((n > 0).sum()), "ones": int((n == 1).sum()), "twos": int((n == 2).sum()), "tokens": int(n.sum()),
        "known": int(((of_word > 0) & (merged.hot < 0)).sum()),
        "hot": merged.hot[hot].tolist(), "hot_n": of_word[hot].tolist(), "hot_tables": tables[hot].astype(float).tolist(), "split": split,
    }


_BLOCK = pa.schema([("bucket", pa.int64()), ("names", pa.binary()), ("fan", pa.binary()), ("heads", pa.binary()), ("tails", pa.binary()), ("n", pa.binary())])
_COUNTED = pa.schema([
    ("bucket", pa.int64()), *[(c, pa.binary()) for c in ("heads", "customers", "singles", "word_singles", "hot_words", "first", "second", "n")],
    *[(c, pa.int64()) for c in ("pairs", "ones", "twos", "tokens", "known")], ("hot", pa.list_(pa.int64())), ("hot_n", pa.list_(pa.int64())), ("hot_tables", pa.list_(pa.float64())), ("split", pa.list_(pa.int64())),
])
_SEATED = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("heads", "customers", "tables", "word_tables")], ("hot", pa.list_(pa.int64())), ("hot_tables", pa.list_(pa.float64()))])
_SHARE = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("heads", pa.binary()), ("customers", pa.binary())])
_REPLY = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("mass", pa.binary()), ("tables", pa.float64())])
_DDL = {pa.int64(): "bigint", pa.binary(): "binary", pa.float64(): "double", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.float64()): "array<double>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def deal_out(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Dealing:
    """rows: text, id, held_out, train. Buckets by the texts' bytes; words and pairs to split, at most four a bucket each."""
    whole = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(whole) // bucket_bytes + 1

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            n = np.bincount(chunk.first, minlength=len(chunk.words))
            key = chunk.pair_keys()
            key.sort()
            starts = _runs(key)
            # Pairs count once a document at most, as they are sent.
            times = np.diff(np.append(starts, len(key)))
            least = len(key) / (8 * buckets)
            found = [(chunk.words[k], None, int(n[k])) for k in np.flatnonzero(n >= least).tolist()]
            for at in np.flatnonzero(times >= least).tolist():
                a, b = divmod(int(key[starts[at]]), len(chunk.words))
                found.append((chunk.words[a], chunk.words[b], int(times[at])))
            found.append((None, None, len(key)))
            a, b, count = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(count, pa.int64())], names=["first", "second", "n"])

    drawn = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE_OF)) == 0)
    counted = drawn.mapInArrow(often, "first binary, second binary, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n"))
    counted = staged(counted, "often")
    total = counted.filter("first is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Shares of over a quarter of a bucket: at most four a bucket.
    hot = counted.filter("first is not null").filter(F.col("n") * 4 * buckets > total).collect()
    words = {bytes(row["first"]) for row in hot if row["second"] is None} | {EDGE}
    return Dealing(buckets, tuple(sorted(words)), tuple(sorted((bytes(row["first"]), bytes(row["second"])) for row in hot if row["second"] is not None)))


def count_pairs(rows: DataFrame, deal: Dealing) -> DataFrame:
    """A row a bucket."""
    hot_pairs = {(a, xxhash.xxh3_64_intdigest(b)): k for k, (a, b) in enumerate(deal.hot_pairs)}

    def blocks(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        key = chunk.pair_keys()
        key *= 2
        key += ~chunk.train[chunk.doc]
        chunk.first = chunk.second = chunk.doc = None
        key.sort()
        starts = _runs(key)
        times = np.diff(np.append(starts, len(key))).astype(np.int32)
        key = key[starts]
        times[key % 2 == 1] = 0
        key //= 2
        pairs = _runs(key)
        times = np.add.reduceat(times, pairs)
        first, second = np.divmod(key[pairs], len(chunk.words))
        del key, starts, pairs
        for bucket, own, names in _blocks(chunk, first, second, deal):
            yield _batch([{"bucket": bucket, **names, "n": pack(times[own])}], _BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield from blocks(chunk)
            del chunk  # before the next one is gathered

    def merge(table: pa.Table) -> pa.Table:
        merged = Merged(table, deal.hot_words)
        n = np.concatenate([unpack(x) for x in table["n"].to_pylist()])[merged.order]
        n = np.add.reduceat(n, merged.starts)
        return pa.Table.from_batches([_batch([{"bucket": table["bucket"][0].as_py(), **_bucket_totals(n, merged, hot_pairs)}], _COUNTED)])

    return staged(rows.mapInArrow(cut, _ddl(_BLOCK)).groupBy("bucket").applyInArrow(merge, _ddl(_COUNTED)), "pairs")


@dataclass(frozen=True)
class Known:
    """Numbers of the whole training set. hot_n, hot_tables: of the hot words."""

    tokens: int
    words: int
    pairs: int
    discount: float
    hot_n: np.ndarray
    hot_tables: np.ndarray


def _hot_sums(df: DataFrame, deal: Dealing, column: str) -> np.ndarray:
    out = np.zeros(len(deal.hot_words))
    rows = df.select(F.explode(F.arrays_zip("hot", column)).alias("x")).groupBy("x.hot").agg(F.sum(f"x.{column}").alias("total"))
    for row in rows.collect():  # at most as many as hot words
        out[row["hot"]] = row["total"]
    return out


def totals_of(counted: DataFrame, deal: Dealing) -> Known:
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "known", "pairs", "ones", "twos")]).first()
    hot_n = _hot_sums(counted, deal, "hot_n").astype(np.int64)
    discount = min(0.95, max(0.05, sums["ones"] / max(1, sums["ones"] + 2 * sums["twos"])))
    return Known(sums["tokens"], sums["known"] + int((hot_n > 0).sum()), sums["pairs"], discount, hot_n, _hot_sums(counted, deal, "hot_tables"))


def _parent(of_buckets: DataFrame, deal: Dealing, known: Known, settings: Settings, turn: int) -> tuple[DataFrame, np.ndarray]:
    """Replies to buckets: the seated mass of each of their second words; and the parent's tables and customers."""
    edges = deal.shard_edges()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                heads, customers = np.frombuffer(row["heads"], dtype=np.uint64), unpack(row["customers"])
                cuts = [0, *np.searchsorted(heads, edges).tolist(), len(heads)]
                for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield _batch([{"shard": shard, "bucket": row["bucket"], "heads": heads[a:b].tobytes(), "customers": pack(customers[a:b])}], _SHARE)

    def seat(table: pa.Table) -> pa.Table:
        buckets = table["bucket"].to_numpy()
        order = np.argsort(buckets)
        heads = [np.frombuffer(table["heads"][int(k)].as_py(), dtype=np.uint64) for k in order]
        customers = np.concatenate([unpack(table["customers"][int(k)].as_py()) for k in order])
        dishes, place = np.unique(np.concatenate(heads), return_inverse=True)
        total = np.bincount(place, weights=customers, minlength=len(dishes)).astype(np.int64)
        shard = table["shard"][0].as_py()
        many = np.flatnonzero(total > 1)
        others = known.words - len(many)  # each known token has a table at least
        chance = np.full(len(many), 1 / (known.words + 1))
        rng = np.random.default_rng([settings.seed, turn, 1, shard])
        seating = Seating(total[many], np.zeros(len(many), dtype=np.int64), np.array([max(others, 0)]), chance, settings.parent_discount, settings.parent_strength, rng)
        tables = (total > 0).astype(float)
        tables[many] = seating.sample(settings)
        mass = (total - settings.parent_discount * tables)[place].astype(np.float32)
        cuts = np.cumsum([0, *map(len, heads)])
        rows = [{"bucket": int(buckets[k]), "shard": shard, "mass": mass[a:b].tobytes(), "tables": float(tables.sum()) if not n else 0.0} for n, (k, a, b) in enumerate(zip(order, cuts, cuts[1:]))]
        return pa.Table.from_batches([_batch(rows, _REPLY)])

    shares = of_buckets.select("bucket", "heads", "customers").mapInArrow(send, _ddl(_SHARE))
    replies = staged(shares.groupBy("shard").applyInArrow(seat, _ddl(_REPLY)), "parent")
    return replies, float(replies.agg(F.coalesce(F.sum("tables"), F.lit(0.0))).first()[0])


def _chances(mass: list[tuple[int, bytes]], tables: float, customers: float, known: Known, settings: Settings) -> np.ndarray:
    """The parent's probabilities from the masses of all shards."""
    own = np.concatenate([np.frombuffer(m, dtype=np.float32) for _, m in sorted(mass)]).astype(float)
    return (own + (settings.parent_strength + settings.parent_discount * tables) / (known.words + 1)) / (settings.parent_strength + customers)


def _children(counted: DataFrame, replies: DataFrame, parent_tables: float, customers: float, known: Known, settings: Settings, turn: int) -> DataFrame:
    def seat(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.Table.from_batches([], schema=_SEATED)
        row = own.to_pylist()[0]
        chance = _chances(list(zip(answers["shard"].to_pylist(), answers["mass"].to_pylist())), parent_tables, customers, known, settings)
        first, second, n = unpack(row["first"]), unpack(row["second"]), unpack(row["n"])
        singles, hot = unpack(row["word_singles"]), np.frombuffer(row["hot_words"], dtype=np.int32).astype(np.int64) - 1
        local = singles + np.bincount(first, minlength=len(singles))
        elsewhere = np.zeros(len(singles), dtype=np.int64)
        is_hot = hot >= 0
        elsewhere[is_hot] = np.maximum(0, known.hot_tables[hot[is_hot]] - local[is_hot]).astype(np.int64)
        rng = np.random.default_rng([settings.seed, turn, 2, row["bucket"]])
        seating = Seating(n, first, singles + elsewhere, chance[second], known.discount, settings.strength, rng)
        mean = seating.sample(settings)
        word_tables = singles + np.bincount(first, weights=mean, minlength=len(singles))
        to_parent = unpack(row["singles"]) + np.bincount(second, weights=seating.tables, minlength=len(chance)).astype(np.int64)
        out = {"bucket": row["bucket"], "heads": row["heads"], "customers": pack(to_parent), "tables": mean.astype(np.float32).tobytes(), "word_tables": word_tables.astype(np.float64).tobytes(), "hot": hot[is_hot].tolist(), "hot_tables": word_tables[is_hot].tolist()}
        return pa.Table.from_batches([_batch([out], _SEATED)])

    state = counted.select("bucket", "heads", "singles", "word_singles", "hot_words", "first", "second", "n")
    return staged(state.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(seat, _ddl(_SEATED)), "seated")


@dataclass(frozen=True)
class Chances:
    """What turns the parent's masses into probabilities."""

    known: Known
    settings: Settings
    tables: float
    customers: float

    def of(self, answers: pa.Table) -> np.ndarray:
        return _chances(list(zip(answers["shard"].to_pylist(), answers["mass"].to_pylist())), self.tables, self.customers, self.known, self.settings)

    def log10(self, n: np.ndarray, tables: np.ndarray, word_n: np.ndarray, word_tables: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Of pairs with n customers at so many tables, in restaurants of word_n customers at word_tables."""
        discount, strength = self.known.discount, self.settings.strength
        return np.log10((n - discount * tables + (strength + discount * word_tables) * chance) / (strength + word_n))


@dataclass(frozen=True)
class Model:
    """counted, seated and replies: tables in the shared folder, a row or more a bucket."""

    deal: Dealing
    chances: Chances
    counted: DataFrame
    seated: DataFrame
    replies: DataFrame


def _customers(of_buckets: DataFrame) -> int:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [int(unpack(x).sum()) for x in batch.column(0).to_pylist()]})

    return of_buckets.select("customers").mapInArrow(add, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fit(rows: DataFrame, settings: Settings, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """rows: text, id, held_out, train."""
    deal = deal_out(rows, bucket_bytes)
    counted = count_pairs(rows, deal)
    known = totals_of(counted, deal)
    customers = float(known.pairs)
    replies, tables = _parent(counted, deal, known, settings, 0)
    for turn in range(1, settings.rounds + 1):
        seated = _children(counted, replies, tables, customers, known, settings, turn)
        customers = float(_customers(seated))
        known = Known(known.tokens, known.words, known.pairs, known.discount, known.hot_n, _hot_sums(seated, deal, "hot_tables"))
        replies, tables = _parent(seated, deal, known, settings, turn)
    return Model(deal, Chances(known, settings, tables, customers), counted, seated, replies)


def _split_values(model: Model) -> dict[tuple[bytes, bytes], tuple[float, int]]:
    """Of each split pair log10 of its probability and the first word's customers."""
    chances = model.chances
    known = chances.known
    own = model.counted.filter(F.size("split") > 0).select("bucket", "split", "hot_words").join(model.seated.select("bucket", "tables", "word_tables"), "bucket")

    def look(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            chance = chances.of(answers)
            means, word_tables = np.frombuffer(row["tables"], dtype=np.float32), np.frombuffer(row["word_tables"])
            hot = np.frombuffer(row["hot_words"], dtype=np.int32).astype(np.int64) - 1
            for pair, n, word_n, a, b, at in zip(*[iter(row["split"])] * 6):
                tables, word_n = (known.hot_tables[hot[a]], int(known.hot_n[hot[a]])) if hot[a] >= 0 else (word_tables[a], word_n)
                out.append({"pair": pair, "value": float(chances.log10(n, means[at] if at >= 0 else n, word_n, tables, chance[b])), "n": word_n})
        return pa.Table.from_pylist(out, schema=pa.schema([("pair", pa.int64()), ("value", pa.float64()), ("n", pa.int64())]))

    found = own.groupBy("bucket").cogroup(model.replies.groupBy("bucket")).applyInArrow(look, "pair bigint, value double, n bigint")
    return {model.deal.hot_pairs[row["pair"]]: (row["value"], row["n"]) for row in found.collect()}  # at most four a bucket


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score). rows: text, id, held_out, train, as in `fit`."""
    deal, chances = model.deal, model.chances
    known = chances.known
    kind = dict(rows.dtypes)["id"]
    ones = known.tokens + known.words + 1
    split = _split_values(model) if deal.hot_pairs else {}
    packed = ["names", "fan", "heads", "tails", "n", "entries", "docs", "times", "score", "base", "known", "n_tokens"]
    sums = ["docs", "score", "base", "known", "n_tokens"]

    def ddl(first: str, columns: list[str]) -> str:
        return f"{first}chunk bigint, {', '.join(f'{c} binary' for c in columns)}, ids array<{kind}>, held array<boolean>"

    def layout(id_type: pa.DataType, columns: list[str], bucket: bool) -> pa.Schema:
        return pa.schema([*[("bucket", pa.int64())] * bucket, ("chunk", pa.int64()), *[(c, pa.binary()) for c in columns], ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_()))])

    def send(chunk: _Chunk, number: int) -> Iterator[pa.RecordBatch]:
        schema = layout(chunk.info.schema.field("id").type, packed, True)
        key = chunk.pair_keys()
        key *= chunk.docs
        key += chunk.doc
        chunk.first = chunk.second = chunk.doc = None
        key.sort()
        starts = _runs(key)
        times = np.diff(np.append(starts, len(key))).astype(np.int32)
        key = key[starts]
        doc = (key % chunk.docs).astype(np.int32)
        key //= chunk.docs
        heads = _runs(key)
        entries = np.diff(np.append(heads, len(key)))
        n = np.add.reduceat(times * chunk.train[doc], heads)
        pairs = key[heads]
        del key, starts
        first, second = np.divmod(pairs, len(chunk.words))
        # Split pairs are added up here; their entries are not sent.
        own_sums = np.zeros((3, chunk.docs))
        sent = np.ones(len(heads), dtype=bool)
        for (a, b), (value, word_n) in split.items():
            if a in chunk.places and b in chunk.places:
                at = int(np.searchsorted(pairs, chunk.places[a] * len(chunk.words) + chunk.places[b]))
                if at < len(heads) and first[at] == chunk.places[a] and second[at] == chunk.places[b]:
                    span = slice(heads[at], heads[at] + entries[at])
                    own_sums[:, doc[span]] += np.array([[value], [np.log10((word_n + 1) / ones)], [word_n > 0]]) * times[span]
                    sent[at] = False
        info = {"bucket": -1 - number % deal.buckets, "chunk": number, "ids": chunk.info["id"].to_pylist(), "held": chunk.info["held_out"].to_pylist(), "n_tokens": pack(chunk.n_tokens)}
        yield _batch([info | {"score": own_sums[0].tobytes(), "base": own_sums[1].tobytes(), "known": pack(own_sums[2].astype(np.int64))}], schema)
        entries_sent = np.where(sent, entries, 0)
        for bucket, own, names in _blocks(chunk, first, second, deal):
            some = own[sent[own]]
            at = np.repeat(heads[some] - (np.cumsum(entries[some]) - entries[some]), entries[some]) + np.arange(int(entries[some].sum()))
            row = {"bucket": bucket, "chunk": number, **names, "n": pack(n[own]), "entries": pack(entries_sent[own]), "docs": pack(doc[at]), "times": pack(times[at])}
            yield _batch([row], schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for chunk in _chunks(batches):
            yield from send(chunk, number)
            del chunk  # before the next one is gathered
            number += 1

    def add(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        schema = layout(blocks.schema.field("ids").type.value_type, sums, False)
        if not blocks.num_rows:
            return pa.Table.from_batches([], schema=schema)
        if blocks["bucket"][0].as_py() < 0:
            return blocks.select(schema.names)
        merged = Merged(blocks, deal.hot_words)
        pair_of = merged.pair_of()
        n = np.bincount(pair_of, weights=np.concatenate([unpack(x) for x in blocks["n"].to_pylist()]), minlength=len(merged.starts)).astype(np.int64)
        state = answers.filter(pa.compute.equal(answers["shard"], -1)).to_pylist()[0]
        chance = chances.of(answers.filter(pa.compute.not_equal(answers["shard"], -1)))
        word_n, word_tables = merged.by_word(n), np.frombuffer(state["word_tables"]).copy()
        hot = np.flatnonzero(merged.hot >= 0)
        word_n[hot], word_tables[hot] = known.hot_n[merged.hot[hot]], known.hot_tables[merged.hot[hot]]
        tables = (n > 0).astype(float)
        tables[n > 1] = np.frombuffer(state["tables"], dtype=np.float32)
        value = chances.log10(n, tables, word_n[merged.first], word_tables[merged.first], chance[merged.second])
        base, is_known = np.log10((word_n + 1) / ones)[merged.first], (word_n > 0)[merged.first]
        out, at = [], 0
        for block, size in zip(blocks.select(["chunk", "entries", "docs", "times"]).to_pylist(), merged.block_pairs.tolist()):
            of = np.repeat(pair_of[at : at + size], unpack(block["entries"]))
            at += size
            docs, times = unpack(block["docs"]), unpack(block["times"])
            if len(docs):
                found = np.flatnonzero(np.bincount(docs))
                totals = [np.bincount(docs, weights=times * x[of])[found] for x in (value, base, is_known)]
                out.append({"chunk": block["chunk"], "docs": pack(found), "score": totals[0].tobytes(), "base": totals[1].tobytes(), "known": pack(totals[2].astype(np.int64))})
        return pa.Table.from_batches([_batch(out, schema)])

    def finish(table: pa.Table) -> pa.Table:
        whole = table.filter(pa.compute.is_valid(table["n_tokens"])).to_pylist()[0]
        total = [np.frombuffer(whole["score"]).copy(), np.frombuffer(whole["base"]).copy(), unpack(whole["known"])]
        parts = table.filter(pa.compute.is_valid(table["docs"])).select(["docs", "score", "base", "known"])
        for row in sorted(parts.to_pylist(), key=lambda r: (r["score"], r["docs"])):  # rows come in any order
            docs = unpack(row["docs"])
            for own, more in zip(total, (np.frombuffer(row["score"]), np.frombuffer(row["base"]), unpack(row["known"]))):
                own[docs] += more
        ids = pa.array(whole["ids"], table.schema.field("ids").type.value_type)
        columns = [ids, pa.array(whole["held"], pa.bool_()), *map(pa.array, (unpack(whole["n_tokens"]), total[2], total[1], total[0]))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    state = model.seated.select("bucket", F.lit(-1).cast("bigint").alias("shard"), F.lit(None).cast("binary").alias("mass"), "tables", "word_tables")
    nothing = F.lit(None).cast("binary")
    answers = state.unionByName(model.replies.select("bucket", "shard", "mass", nothing.alias("tables"), nothing.alias("word_tables")))
    blocks = rows.mapInArrow(cut, ddl("bucket bigint, ", packed))
    found = blocks.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(add, ddl("", sums))
    return found.groupBy("chunk").applyInArrow(finish, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def learn_and_score(docs: DataFrame, train: Column, held_out: Column, settings: Settings = Settings(), bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, held_out, n_tokens, n_known, train_tokens, base_score, score). train, held_out: over docs' columns; null is false."""
    false = F.lit(False)
    rows = docs.select(F.col(text_column).alias("text"), F.col(id_column).alias("id"), F.coalesce(held_out, false).alias("held_out"), F.coalesce(train, false).alias("train"))
    model = fit(rows, settings, bucket_bytes)
    found = score(rows, model).withColumn("train_tokens", F.lit(model.chances.known.tokens).cast("bigint"))
    return found.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
