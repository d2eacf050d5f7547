"""Touches on and off the keyboard against plain loops."""

from __future__ import annotations

import math

import numpy as np

from wordloom.operators import touch

ROWS = ["qw3", "as;", "z"]


def test_touches_anywhere_have_the_nearest_rows_key_and_its_confusable_neighbours(spark):
    rows = [("x", r, i, c, 0.2) for r, own in enumerate(ROWS) for i, c in enumerate(own)]
    keys = touch.bounds(spark.createDataFrame(rows, "layout string, row int, idx int, base string, width double"))
    own = keys.collect()
    draw = np.random.default_rng(2)
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(draw.uniform(-0.6, 1.6, (300, 2)))] + [(300, 0.5, 1.0), (301, 0.5, 1.3), (302, 0.5, -0.1), (303, 400.0, 0.5), (304, None, 0.5)]
    touches = spark.createDataFrame(places, "touch_id int, tx double, ty double")
    want, signals = {}, {}
    for k, x, y in places[:-1]:
        row = [b for b in own if b["row"] == min(2, max(0, math.floor(y * 3)))]
        inside = [b for b in row if b["x"] <= x < b["x"] + b["w"]]
        pressed = inside[0] if inside else min(row, key=lambda b: (abs(b["x"] + b["w"] / 2 - x), b["idx"]))
        want[k] = pressed["base"]
        weigh = {b["base"]: math.exp(-2 * (((x - b["x"] - b["w"] / 2) / b["w"]) ** 2 + ((y - b["y"] - b["h"] / 2) / b["h"]) ** 2)) for b in own if b["base"].isalpha() == pressed["base"].isalpha()}
        total = sum(weigh.values())
        if not weigh[want[k]]:
            signals[k] = [(want[k], 1.0)]
            continue
        rest = sorted(((-g, c) for c, g in weigh.items() if c != want[k] and g / total >= 0.02))[:3]
        signals[k] = [(want[k], round(weigh[want[k]] / total, 6)), *((c, round(-g / total, 6)) for g, c in rest)]
    assert {r["touch_id"]: r["base"] for r in touch.hit(touches, keys).collect()} == want and len(set(want.values())) == 7
    got = {}
    for r in touch.likelihoods(touches, keys).orderBy("touch_id", "place").collect():
        got.setdefault(r["touch_id"], []).append((r["base"], round(r["p"], 6)))
        assert r["place"] == len(got[r["touch_id"]])
    assert got == signals
