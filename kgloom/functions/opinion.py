"""Subjective-logic opinions as structs of belief, disbelief, uncertainty and base rate (b, d, u, a)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10
# Fixed values, as results must be the same: the prior (alpha, beta) of a source's trust by its type.
TRUST = {"document": (4.0, 1.0), "code": (3.5, 1.5), "api": (3.5, 1.5), "tool_output": (3.5, 1.5), "web_page": (3.0, 2.0), "manual": (3.0, 2.0), "conversation": (2.5, 2.5), "observation": (2.0, 3.0)}
CONTENDS = 0.3


def _num(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def opinion(b, d, u, a=0.5) -> Column:
    return F.struct(*(_num(v).alias(n) for n, v in zip("bdua", (b, d, u, a), strict=True)))


def checked(b, d, u, a=0.5) -> Column:
    """Null unless the parts add up to 1 within 1e-6 and each is in [0, 1]."""
    parts = [_num(v) for v in (b, d, u, a)]
    fine = F.abs(parts[0] + parts[1] + parts[2] - 1) <= 1e-6
    return F.when(reduce(lambda x, y: x & y, [p.between(0.0, 1.0) for p in parts], fine), opinion(*parts))


def vacuous(a=0.5) -> Column:
    return opinion(0, 0, 1, a)


def of_confidence(c: Column) -> Column:
    b = F.least(c, F.lit(0.99))
    return opinion(b, 0.3 * (1 - b), 1 - b - 0.3 * (1 - b))


def projected(o: Column) -> Column:
    return o["b"] + o["a"] * o["u"]


def cumulative(x: Column, y: Column) -> Column:
    k = x["u"] + y["u"] - x["u"] * y["u"]
    one = lambda n: (x[n] * y["u"] + y[n] * x["u"]) / k
    sure = 2 - x["u"] - y["u"]
    rate = F.when(sure > TINY, (x["a"] * (1 - x["u"]) + y["a"] * (1 - y["u"])) / sure).otherwise((x["a"] + y["a"]) / 2)
    half = lambda n: (x[n] + y[n]) / 2
    return F.when(k.between(-TINY, TINY), opinion(half("b"), half("d"), 0, half("a"))).otherwise(opinion(one("b"), one("d"), x["u"] * y["u"] / k, rate))


def averaging(x: Column, y: Column) -> Column:
    s = x["u"] + y["u"]
    half = lambda n: (x[n] + y[n]) / 2
    one = lambda n: (x[n] * y["u"] + y[n] * x["u"]) / s
    return F.when(s <= TINY, opinion(half("b"), half("d"), 0, half("a"))).otherwise(opinion(one("b"), one("d"), 2 * x["u"] * y["u"] / s, half("a")))


def discounted(o: Column, trust: Column) -> Column:
    return opinion(o["b"] * trust, o["d"] * trust, 1 - trust * (o["b"] + o["d"]), o["a"])


def deduced(p: Column, if_true: Column, if_false: Column) -> Column:
    """Mixture of the conditional opinions by the probability of the premise."""
    q = projected(p)
    mix = {n: q * if_true[n] + (1 - q) * if_false[n] for n in "bdua"}
    total = mix["b"] + mix["d"] + mix["u"]
    return opinion(mix["b"] / total, mix["d"] / total, mix["u"] / total, mix["a"])


def dempster_shafer(x: Column, y: Column) -> Column:
    """Null in total conflict."""
    k = x["b"] * y["d"] + x["d"] * y["b"]
    b, d, u = x["b"] * y["b"] + x["b"] * y["u"] + x["u"] * y["b"], x["d"] * y["d"] + x["d"] * y["u"] + x["u"] * y["d"], x["u"] * y["u"]
    return F.when(1 - k > TINY, opinion(b / (1 - k), d / (1 - k), u / (1 - k), (x["a"] + y["a"]) / 2))


def folded(opinions: Column, step) -> Column:
    """Left fold of an array of opinions; vacuous for an empty one. A null step makes the result null."""
    first = F.get(opinions, F.lit(0))
    return F.when(F.size(opinions) == 0, vacuous()).otherwise(F.aggregate(F.slice(opinions, 2, F.greatest(F.size(opinions) - 1, F.lit(0))), first, lambda x, y: F.when(x.isNotNull(), step(x, y))))


def fused(opinions: Column) -> Column:
    """Dempster-Shafer; cumulative fusion where that meets total conflict."""
    return F.coalesce(folded(opinions, dempster_shafer), folded(opinions, cumulative))


def attacked(target: Column, attacker: Column, weight: Column) -> Column:
    return F.least(F.greatest(target * (1 - attacker * weight), F.lit(0.0)), F.lit(1.0))


def superseded(old: Column, new: Column, weight: Column) -> Column:
    return old * (1 - new * weight)


def composite(p: Column, topology: Column, gamma: float = 0.4) -> Column:
    return F.least(F.greatest(p * (1 + gamma * (topology - 0.5)), F.lit(0.0)), F.lit(1.0))


def base_level(days: Column) -> Column:
    """ACT-R activation from the ages in days of a node's accesses."""
    return F.when(F.size(days) == 0, -10.0).otherwise(F.ln(F.aggregate(days, F.lit(0.0), lambda s, t: s + F.pow(F.greatest(t.cast("double"), F.lit(0.001)), F.lit(-0.5)))))


def keep_score(structural: Column, activation: Column, accommodations: Column, contradiction_days: Column) -> Column:
    use = F.least(F.greatest(activation, F.lit(0.0)), F.lit(5.0)) / 5
    return 0.3 * structural + 0.3 * use + 0.25 * F.least(accommodations, F.lit(10)) / 10 - 0.15 * F.least(contradiction_days / 365.0, F.lit(1.0))


def reliability(source_type: Column) -> Column:
    out = F.lit(0.5)
    for name, (a, b) in TRUST.items():
        out = F.when(source_type == name, a / (a + b)).otherwise(out)
    return out
