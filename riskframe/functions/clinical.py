"""Bedside scores on raw units. Every function returns a Column; nothing here reads data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clip, col, cut, flag, ratio, steps

# Thresholds and points of the scores.
HR_POINTS = ((40, 3), (50, 2), (100, 0), (110, 1), (130, 2))
HR_ABOVE = 3
SBP_POINTS = ((70, 3), (80, 2), (100, 1), (199, 0))
SBP_ABOVE = 2
SPO2_POINTS = ((85, 3), (90, 2), (92, 1))
TEMP_LOW_POINTS = ((35, 2), (36, 1))
TEMP_HIGH_POINTS = ((38, 0), (39, 1))
TEMP_ABOVE = 2
SHOCK_CAP = 5.0
SHOCK_HIGH = 0.9
MAP_RANGE = (30.0, 200.0)
MAP_LOW = 65.0
AGE_EDGES = (0, 18, 40, 65, 100)
AGE_LABELS = ("Young", "Adult", "Middle", "Elderly")
ELDERLY_FROM = 65
HR_NORMAL = (60, 100)
SBP_NORMAL = (90, 140)
SPO2_NORMAL_FROM = 95
TEMP_NORMAL = (36, 38)
SEVERE_PAIN_FROM = 7


def hr_points(hr="hr") -> Column:
    return steps(hr, upto=HR_POINTS, above=HR_ABOVE)


def sbp_points(sbp="sbp") -> Column:
    return steps(sbp, upto=SBP_POINTS, above=SBP_ABOVE)


def spo2_points(spo2="spo2") -> Column:
    return steps(spo2, below=SPO2_POINTS, above=0)


def temp_points(temp="temp") -> Column:
    low = steps(temp, below=TEMP_LOW_POINTS, above=0)
    high = steps(temp, upto=TEMP_HIGH_POINTS, above=TEMP_ABOVE)
    return F.when(col(temp) < F.lit(float(TEMP_LOW_POINTS[-1][0])), low).otherwise(high)


def capped_shock_index(hr="hr", sbp="sbp") -> Column:
    """Heart rate over systolic pressure, NULL at zero pressure, capped above."""
    return clip(ratio(hr, sbp), None, SHOCK_CAP)


def mean_pressure(sbp="sbp", dbp="dbp") -> Column:
    return clip(col(dbp) + (col(sbp) - col(dbp)) / F.lit(3.0), *MAP_RANGE)


def low_pressure_flag(sbp="sbp", dbp="dbp") -> Column:
    return flag(mean_pressure(sbp, dbp) < F.lit(MAP_LOW))


def age_band(age="age") -> Column:
    return cut(age, AGE_EDGES, AGE_LABELS)


def elderly_flag(age="age") -> Column:
    return flag(col(age) >= F.lit(float(ELDERLY_FROM)))


def _outside(c, band) -> Column:
    return flag((col(c) < F.lit(float(band[0]))) | (col(c) > F.lit(float(band[1]))))


ABNORMAL = {
    "hr": lambda: _outside("hr", HR_NORMAL),
    "sbp": lambda: _outside("sbp", SBP_NORMAL),
    "spo2": lambda: flag(F.col("spo2") < F.lit(float(SPO2_NORMAL_FROM))),
    "temp": lambda: _outside("temp", TEMP_NORMAL),
}


def severe_pain_flag(pain="pain") -> Column:
    return flag(col(pain) >= F.lit(float(SEVERE_PAIN_FROM)))


def no_pain_flag(pain="pain") -> Column:
    return flag(col(pain) == F.lit(0.0))
