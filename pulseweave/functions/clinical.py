"""Scalar rules on clinical columns: age, ethnicity, dose-rate units, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pulseweave import vocab

# Upper age bound (inclusive) of each named group; above the last, "85>"
AGE_GROUPS = (
    (17, "<18"), (25, "18-25"), (35, "26-35"), (45, "36-45"), (55, "46-55"),
    (65, "56-65"), (75, "66-75"), (85, "76-85"),
)
OLDEST_GROUP = "85>"

# Text searched for in the upper-cased ethnicity, in order = group
ETHNICITY_GROUPS = (
    ("WHITE", "WHITE"),
    ("BLACK", "BLACK/AFRICAN AMERICAN"),
    ("HISPANIC", "HISPANIC/LATINO"),
    ("ASIAN", "ASIAN"),
    ("UNKNOWN", "UNKNOWN"),
    ("UNABLE", "UNKNOWN"),
    ("DECLINED", "UNKNOWN"),
)
OTHER_ETHNICITY = "OTHER"


def not_nan(c: Column) -> Column:
    """NaN to NULL: missing is always NULL past the sources."""
    return F.when(~F.isnan(c), c)


def age_from_birth(admitted: Column, born: Column) -> Column:
    return (F.year(admitted) - F.year(born)).cast("int")


def age_from_anchor(admitted: Column, anchor_age: Column, anchor_year: Column) -> Column:
    return (anchor_age + F.year(admitted) - anchor_year).cast("int")


def age_group(age: Column) -> Column:
    """Right-closed bins; an age of zero or less falls in none of them."""
    first = F.when(age <= 0, F.lit(None).cast("string"))
    binned = reduce(lambda w, g: w.when(age <= g[0], g[1]), AGE_GROUPS, first)
    return binned.when(age.isNotNull(), OLDEST_GROUP)


def ethnicity_group(text: Column) -> Column:
    """First group whose text occurs anywhere in the value.

    The search is by substring, so CAUCASIAN counts as ASIAN; kept on purpose.
    """
    upper = F.upper(text)
    rules = [(upper.contains(needle), group) for needle, group in ETHNICITY_GROUPS]
    first = F.when(*rules[0])
    return reduce(lambda w, r: w.when(*r), rules[1:], first).otherwise(OTHER_ETHNICITY)


def normalized_rate(rate: Column, unit: Column, weight: Column) -> Column:
    """Dose rate per kg and minute; NULL without a rate or weight, other units unchanged.

    Fixed values: the seven convertible units.
    """
    converted = (
        F.when(unit == "mcg/kg/min", rate)
        .when(unit == "ng/kg/min", rate / 1000)
        .when(unit == "mg/kg/hour", rate * 1000 / 60)
        .when(unit == "mcg/hour", F.try_divide(rate, weight) / 60)
        .when(unit == "mg/hour", F.try_divide(rate * 1000, weight) / 60)
        .when(unit == "mg/min", F.try_divide(rate * 1000, weight))
        .when(unit == "units/hour", rate / 60)
        .otherwise(rate)
    )
    return F.when(rate.isNotNull() & weight.isNotNull(), converted)


def weight_in_kg(value: Column, label: Column) -> Column:
    pounds = label == vocab.WEIGHT_LABEL_LBS
    return F.when(pounds, value * F.lit(vocab.KG_PER_LB)).otherwise(value)


def plausible_weight(kg: Column) -> Column:
    return kg.between(vocab.WEIGHT_MIN_KG, vocab.WEIGHT_MAX_KG)


def norepi_equivalent(rate_of) -> Column:
    """Weighted dose sum over six drugs, added in a fixed order; missing counts as 0.

    ``rate_of`` maps a drug name to its normalised-rate column.
    """
    terms = [
        F.coalesce(rate_of(drug), F.lit(0.0)) * F.lit(factor)
        for drug, factor in vocab.NOREPI_FACTORS.items()
    ]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))
