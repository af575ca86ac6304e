"""Column expressions: hashing to uniforms, boxes, probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("d", "h", "w")
#: float32 machine epsilon, the floor of probabilities in focal losses.
EPS32 = 2.0**-23


def uniform(seed: int, field: str, *keys: Column) -> Column:
    """Uniform in [0, 1) from the md5 of seed, field and keys: the same under any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(field), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(seed: int, field: str, *keys: Column) -> Column:
    """Standard normal by Box-Muller on two such uniforms."""
    u, v = uniform(seed, field + ".u", *keys), uniform(seed, field + ".v", *keys)
    return F.sqrt(-2.0 * F.log(F.greatest(u, F.lit(2.0**-48)))) * F.cos(2.0 * math.pi * v)


def softmax2(l0: Column, l1: Column) -> Column:
    """Probability of class 1 of two logits; exp never overflows."""
    return F.when(l1 >= l0, 1.0 / (1.0 + F.exp(l0 - l1))).otherwise(F.exp(l1 - l0) / (1.0 + F.exp(l1 - l0)))


def box(centre: dict[str, Column], size: dict[str, Column]) -> Column:
    return F.struct(*[centre[a].alias(a) for a in AXES], *[size[a].alias("s" + a) for a in AXES])


def corners(b: Column, clip: bool = True) -> Column:
    """Struct d0 h0 d1 h1 w0 w1 of a centre-size box, clipped to [0, 1] unless told otherwise."""
    edge = (lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))) if clip else (lambda c: c)
    low = {a: edge(b[a] - b["s" + a] / 2) for a in AXES}
    high = {a: edge(b[a] + b["s" + a] / 2) for a in AXES}
    return F.struct(low["d"].alias("d0"), low["h"].alias("h0"), high["d"].alias("d1"), high["h"].alias("h1"), low["w"].alias("w0"), high["w"].alias("w1"))


def corner_struct(low: dict[str, Column], high: dict[str, Column]) -> Column:
    return F.struct(low["d"].alias("d0"), low["h"].alias("h0"), high["d"].alias("d1"), high["h"].alias("h1"), low["w"].alias("w0"), high["w"].alias("w1"))


def volume(c: Column, clamp: bool = True) -> Column:
    """Volume of corners; with clamp, sides below 0 count as 0."""
    side = (lambda a: F.greatest(c[a + "1"] - c[a + "0"], F.lit(0.0))) if clamp else (lambda a: c[a + "1"] - c[a + "0"])
    return side("d") * side("h") * side("w")


def overlap(a: Column, b: Column) -> Column:
    side = lambda x: F.greatest(F.least(a[x + "1"], b[x + "1"]) - F.greatest(a[x + "0"], b[x + "0"]), F.lit(0.0))
    return side("d") * side("h") * side("w")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of corners; 0 where the union is not positive."""
    inter = overlap(a, b)
    union = volume(a) + volume(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def giou(a: Column, b: Column) -> Column:
    """Generalised IoU of unclipped corners."""
    inter = overlap(a, b)
    union = volume(a, clamp=False) + volume(b, clamp=False) - inter
    side = lambda x: F.greatest(a[x + "1"], b[x + "1"]) - F.least(a[x + "0"], b[x + "0"])
    hull = side("d") * side("h") * side("w")
    return inter / union - (hull - union) / hull
