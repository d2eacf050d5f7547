"""Touch geometry: keys as rectangles of the unit square, touches, key likelihoods, neighbouring keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spread of touches in keys, least share that counts, keys a touch may stand for, the ellipse of neighbours.
SPREAD = 0.5
LEAST_SHARE = 0.02
MOST_KEYS = 4
NEAR_X, NEAR_Y = 0.12, 0.27


def bounds(rows: DataFrame) -> DataFrame:
    """keys(layout, row, idx, base, width) -> with x, y, w, h: a row's keys follow each other, centred; rows share the height."""
    by = Window.partitionBy("layout", "row")
    left = F.coalesce(F.sum("width").over(by.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("width").over(by)
    n = F.max("row").over(Window.partitionBy("layout")) + 1
    return rows.select("layout", "row", "idx", "base", ((1 - total) / 2 + left).alias("x"), (F.col("row") / n).alias("y"), F.col("width").alias("w"), (1 / n).alias("h"))


def _centre(a: str) -> tuple[Column, Column]:
    return F.col(f"{a}.x") + F.col(f"{a}.w") / 2, F.col(f"{a}.y") + F.col(f"{a}.h") / 2


def _literal(keys: DataFrame) -> tuple[Column, Column]:
    """One layout's keys, a few dozen, as an array of structs, and the row of a touch at ty: above and below the keyboard the nearest."""
    rows = [r.asDict() for r in keys.select("row", "idx", "base", "x", "y", "w", "h").collect()]
    one = lambda r: F.struct(*[F.lit(float(r[c]) if c in "xywh" else r[c]).alias(c) for c in ("row", "idx", "base", "x", "y", "w", "h")], F.lit(r["base"]).rlike(r"^\p{IsAlphabetic}").alias("letter"))
    tops = sorted({(float(r["y"]), r["row"]) for r in rows})
    row = F.lit(tops[0][1])
    for top, number in tops[1:]:
        row = F.when(F.col("ty") >= top, number).otherwise(row)
    return F.array(*[one(r) for r in rows]), row


def _pressed(keys: Column, row: Column) -> Column:
    """The key of the row that holds tx, else the one whose centre is nearest, ties to the left."""
    inside = lambda k: (F.col("tx") >= k["x"]) & (F.col("tx") < k["x"] + k["w"])
    far = lambda k: F.when(inside(k), -1.0).otherwise(F.abs(k["x"] + k["w"] / 2 - F.col("tx")))
    return F.array_min(F.transform(F.filter(keys, lambda k: k["row"] == row), lambda k: F.struct(far(k).alias("far"), k["idx"].alias("idx"), k["base"].alias("base"), k["letter"].alias("letter"))))


def hit(touches: DataFrame, keys: DataFrame) -> DataFrame:
    """(.., base): the key at the touch (tx, ty), inside the keyboard or off it. Touches without a place go. keys: one layout."""
    array, row = _literal(keys)
    return touches.filter("tx IS NOT NULL AND ty IS NOT NULL").withColumn("base", _pressed(array, row)["base"])


def likelihoods(touches: DataFrame, keys: DataFrame) -> DataFrame:
    """(.., base, p, place): shares of a Gaussian around the touch in key widths and heights, among keys that can be confused with the pressed one (letters with letters); the pressed key first, then by share, ties by character. Where the pressed key has no share it is certain."""
    array, row = _literal(keys)
    asked = touches.filter("tx IS NOT NULL AND ty IS NOT NULL").withColumn("__hit", _pressed(array, row)).withColumn("__keys", F.filter(array, lambda k: k["letter"] == F.col("__hit.letter")))
    dx = lambda k: (F.col("tx") - (k["x"] + k["w"] / 2)) / k["w"]
    dy = lambda k: (F.col("ty") - (k["y"] + k["h"] / 2)) / k["h"]
    weight = lambda k: F.exp(-(dx(k) * dx(k) + dy(k) * dy(k)) / (2 * SPREAD * SPREAD))
    asked = asked.withColumn("__keys", F.transform("__keys", lambda k: F.struct((-weight(k)).alias("less"), k["base"].alias("base"))))
    asked = asked.withColumn("__total", F.aggregate("__keys", F.lit(0.0), lambda t, k: t - k["less"]))
    share = lambda k: -k["less"] / F.col("__total")
    named = lambda k, p: F.struct(k["base"].alias("base"), p.alias("p"))
    own = F.filter("__keys", lambda k: k["base"] == F.col("__hit.base"))[0]
    others = F.filter("__keys", lambda k: (k["base"] != F.col("__hit.base")) & (share(k) >= LEAST_SHARE))
    shown = F.concat(F.array(named(own, share(own))), F.transform(F.slice(F.array_sort(others), 1, MOST_KEYS - 1), lambda k: named(k, share(k))))
    certain = F.array(named(F.col("__hit"), F.lit(1.0)))
    rows = asked.select(*touches.columns, F.posexplode(F.when(-own["less"] > 0, shown).otherwise(certain)).alias("at", "key"))
    return rows.select(*touches.columns, "key.base", "key.p", (F.col("at") + 1).alias("place"))


def neighbours(keys: DataFrame) -> DataFrame:
    """(base, near, d2): pairs of a layout's keys whose centres are within the ellipse."""
    ax, ay = _centre("a")
    bx, by = _centre("b")
    d2 = ((ax - bx) / NEAR_X) * ((ax - bx) / NEAR_X) + ((ay - by) / NEAR_Y) * ((ay - by) / NEAR_Y)
    met = keys.alias("a").join(F.broadcast(keys.alias("b")), (F.col("a.layout") == F.col("b.layout")) & (F.col("a.base") != F.col("b.base")) & (d2 <= 1))
    return met.select(F.col("a.layout").alias("layout"), F.col("a.base").alias("base"), F.col("b.base").alias("near"), d2.alias("d2"))
