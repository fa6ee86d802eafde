"""Deterministic hash fractions: the only source of chance in derived streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_fraction(*parts) -> Column:
    """A number in [0, 1) from the parts joined by '|': the first 64 bits of their sha256 over 2^64."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    first = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return first / F.lit(18446744073709551616.0)


def feedback(event: Column, ratio: float, seed: int = 0) -> Column:
    """Whether an event's outcome is written; masks of growing ratio are nested."""
    if ratio >= 1:
        return F.lit(True)
    if ratio <= 0:
        return F.lit(False)
    text = F.concat(F.lit(f"{seed}:"), event.cast("string"))
    first = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return first / F.lit(18446744073709551616.0) < F.lit(ratio)
