"""Fixed-point ratios as columns, and number texts that are finished on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(numerator: Column, denominator: Column, scale: int = 1) -> Column:
    """numerator * scale / denominator with six decimals, half up, as text; '0.000000' for a zero denominator."""
    wide = "decimal(38,0)"
    n, d = numerator.cast(wide), denominator.cast(wide)
    million = F.lit(1_000_000).cast("bigint")
    # floor((2 n s 10^6 + d) / 2 d) in exact integers; the quotient itself is small enough for a bigint.
    twice = (n * F.lit(2_000_000 * scale).cast("decimal(12,0)") + d).cast(wide)
    q = F.floor((twice - F.pmod(twice, (d * 2).cast(wide))) / F.when(d == 0, None).otherwise(d * 2)).cast("bigint")
    text = F.concat((q / million).cast("bigint").cast("string"), F.lit("."), F.lpad((q % million).cast("string"), 6, "0"))
    return F.when(denominator == 0, "0.000000").otherwise(text)


def ratio_six(n: int, d: int) -> str:
    """n / d with six decimals, half up; '0.000000' for d = 0."""
    q = (2_000_000 * n + d) // (2 * d) if d else 0
    return f"{q // 1_000_000}.{q % 1_000_000:06d}"


def percent_six(n: int, d: int) -> str:
    return ratio_six(100 * n, d)


def percent_two(n: int, d: int) -> str:
    """Percent in hundredths, half up, 'N/A' for an empty total."""
    if not d:
        return "N/A"
    q = (n * 10_000 + d // 2) // d
    return f"{q // 100}.{q % 100:02d}%"


def single(n: float, d: float) -> np.float32:
    """Quotient in single precision; 0 for a zero denominator."""
    return np.float32(n) / np.float32(d) if d else np.float32(0)


def whole_text(n: int, d: int) -> str:
    """'%.0f' of the single-precision quotient."""
    return format(float(single(n, d)), ".0f")


def plain_float(x: float | None) -> str:
    """Six decimals without trailing zeros, '?' where there is no finite value."""
    if x is None or not math.isfinite(x):
        return "?"
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text
