"""Interpersonal circumplex: octant, intensity, fit, and the rotation of Big-Five scores, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the octants at 0, 45, ... 315 degrees.
OCTANTS = ("affinity", "active", "dominant", "arrogant", "cold", "withdrawn", "submissive", "deferential")
#: Loadings of (agreeableness, extraversion, neuroticism) and (extraversion, conscientiousness, neuroticism).
BENEVOLENCE = (0.70, 0.35, -0.20)
POWER = (0.70, 0.35, -0.15)
#: Spellings of a label.
SPELLINGS = {
    "亲和": "affinity", "活跃": "active", "掌控": "dominant", "高傲": "arrogant",
    "冷淡": "cold", "孤避": "withdrawn", "顺应": "submissive", "谦让": "deferential",
    "友好": "affinity", "积极": "active", "支配": "dominant", "傲慢": "arrogant",
    "疏远": "cold", "敌意": "cold", "孤立": "withdrawn", "服从": "submissive",
    "顺从": "submissive", "谦逊": "deferential", "掌控友好": "dominant", "支配友好": "dominant",
    "friend": "affinity", "friendly": "affinity", "family": "affinity", "rival": "cold", "stranger": "cold",
}
ORIGIN = 1e-9


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def angle(b: Column, p: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(p, b)), F.lit(360.0))


def octant_number(b: Column, p: Column) -> Column:
    at_origin = (F.abs(b) < ORIGIN) & (F.abs(p) < ORIGIN)
    return F.when(at_origin, 0).otherwise(F.pmod(F.rint(angle(b, p) / 45).cast("int"), F.lit(8)))


def octant(b: Column, p: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, OCTANTS)), octant_number(b, p) + 1)


def intensity(b: Column, p: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt(b * b + p * p) / F.sqrt(F.lit(2.0)))


def fit(b: Column, p: Column) -> Column:
    """1 at the middle of the octant, 0 at its border; 0.5 without direction."""
    off = F.abs(angle(b, p) - 45 * octant_number(b, p))
    off = F.least(off, 360 - off)
    return F.when(F.sqrt(b * b + p * p) < 1e-6, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1 - off / 22.5))


def rotate(o: Column, c: Column, e: Column, a: Column, n: Column) -> tuple[Column, Column]:
    """Benevolence and power of Big-Five scores; openness has no loading."""
    del o
    return (
        clamp(BENEVOLENCE[0] * a + BENEVOLENCE[1] * e + BENEVOLENCE[2] * n),
        clamp(POWER[0] * e + POWER[1] * c + POWER[2] * n),
    )


def heuristic(shared: Column, salience: Column) -> tuple[Column, Column]:
    """Benevolence and power from the number of shared events, where no scores exist."""
    close = shared >= 10
    return (
        F.least(F.lit(1.0), F.when(close, 0.3 + 0.4 * salience).otherwise(0.1 + 0.3 * salience)),
        F.when(close, 0.2).otherwise(0.0),
    )


def normalize_label(label: Column, unknown: Column | str = "affinity") -> Column:
    """The English label of any spelling; what is unknown becomes affinity by default."""
    out = F.when(label.isin(*OCTANTS), label)
    for spelling, name in SPELLINGS.items():
        out = out.when(label == spelling, name)
    return out.otherwise(unknown)


def ema(new: Column, old: Column, alpha: float = 0.4) -> Column:
    return alpha * new + (1 - alpha) * old
