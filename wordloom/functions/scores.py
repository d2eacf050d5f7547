"""Scores: logarithms of counts, quantised frequencies, edit costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scale.
MAX_FREQUENCY = 65535
STEP = 256
EDIT_PENALTY = MAX_FREQUENCY // 4
AUTOCORRECT_MARGIN = MAX_FREQUENCY // 12
USE_WEIGHT = MAX_FREQUENCY // 10
RECENT_BONUS = MAX_FREQUENCY // 4
RECENT_SPAN = 10
LEARNED_USES = 2
EDIT = 100


def logarithmic(count: Column) -> Column:
    return F.when(count > 0, F.log1p(count)).otherwise(F.lit(0.0))


def quantise(score: Column, highest: Column) -> Column:
    """1 to MAX_FREQUENCY in steps; the highest score is MAX_FREQUENCY."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / highest))
    fine = 1 + F.round(share * (MAX_FREQUENCY - 1)).cast("bigint")
    coarse = F.floor((fine + STEP // 2) / STEP).cast("bigint") * STEP
    return F.greatest(F.lit(1), F.least(F.lit(MAX_FREQUENCY), coarse)).cast("int")


def edit_budget(key: Column) -> Column:
    """The cost that corrections of a typed key may have, by its length."""
    n = F.char_length(key)
    return F.when(n < 2, 0).when(n < 10, EDIT).otherwise(2 * EDIT)


def combine(frequency: Column, personal: Column, context: Column, cost: Column) -> Column:
    """A candidate's score; the penalty's division truncates."""
    penalty = F.floor(cost.cast("bigint") * EDIT_PENALTY / EDIT).cast("bigint")
    return frequency.cast("bigint") + personal.cast("bigint") + context.cast("bigint") - penalty


def personal_weight(count: Column, age: Column) -> Column:
    """What a user's own uses of a word weigh; age: uses of any word since."""
    return count * USE_WEIGHT + F.when(age < RECENT_SPAN, RECENT_BONUS).otherwise(0)
