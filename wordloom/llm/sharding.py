"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table.

Each shard has its own order of preference over the slots, rank(slot) = (slot - offset) * stride mod size, a
permutation because the size is prime and the stride is not 0. Turn t belongs to shard t mod n, which claims its most
preferred free slot; after `size` turns every slot has an owner and two shards differ by one slot at most. A key's slot
is a hash of it, so placing a key is one look-up in a table whose size is a parameter, broadcast to every task.

Only DataFrame functions are used. Nulls: a null key is placed as the empty string. Repeated keys go to the same shard,
very long keys are hashed whole, empty tables give no rows, and columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table at most. The fill is one fold whose cost grows with the square of the size: seconds for 4,099, about a minute for this.
LARGEST_TABLE = 16_411


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def hex_number(text: Column, first: int) -> Column:
    """Eight hex digits of the text's MD5, from position `first`, as a number."""
    return F.conv(F.substring(F.md5(text), first, 8), 16, 10).cast("bigint")


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard) for each of `size` slots; the fill runs as one fold over the turns."""
    if not _is_prime(size) or not len(set(shards)) == len(shards) <= size <= LARGEST_TABLE or not shards:
        raise ValueError("the table's size must be a prime from the number of distinct shards to LARGEST_TABLE")
    n = len(shards)
    named = F.array(*map(F.lit, shards))
    one = spark.range(1).select(
        F.transform(named, lambda s: F.struct((hex_number(s, 1) % size).alias("offset"), (hex_number(s, 9) % (size - 1) + 1).alias("stride"))).alias("prefers"),
        F.sequence(F.lit(0).cast("bigint"), F.col("id") + size - 1).alias("slots"),
    )

    def turn(state: Column, t: Column) -> Column:
        mine = F.get("prefers", (t % n).cast("int"))
        best = F.array_min(F.transform(state.free, lambda s: F.struct(F.pmod((s - mine.offset) * mine.stride, F.lit(size)).alias("rank"), s.alias("slot"))))
        return F.get(
            F.transform(F.array(best.slot), lambda s: F.struct(F.array_remove(state.free, s).alias("free"), F.array_append(state.claims, s).alias("claims"))),
            0,
        )

    start = F.struct(F.col("slots").alias("free"), F.array().cast("array<bigint>").alias("claims"))
    claims = one.select(F.posexplode(F.aggregate("slots", start, turn).claims).alias("turn", "slot"))
    return claims.select("slot", F.get(named, (F.col("turn") % n).cast("int")).alias("shard"))


def slot_column(key: Column, size: int) -> Column:
    return hex_number(F.coalesce(key.cast("string"), F.lit("")), 1) % size


def place(df: DataFrame, key: str, table: DataFrame, size: int) -> DataFrame:
    """df with the key's slot and shard."""
    slim = table.select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*kept, slot_column(F.col(key), size).alias("slot"))
    return placed.join(F.broadcast(slim), F.col("slot") == F.col("__slot")).select(*kept, "slot", F.col("__shard").alias("shard"))
