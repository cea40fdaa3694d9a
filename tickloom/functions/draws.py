"""Random numbers that any engine can repeat: hashes of a seed and a row's key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: Column | int, *key: Column | str) -> Column:
    """A number in ``[0, 2**60)`` from the seed and the key, alike on every partitioning; null parts are passed over."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    written = F.concat_ws("|", *[c.cast("string") for c in (seed, *(F.col(k) if isinstance(k, str) else k for k in key))])
    return F.conv(F.substring(F.md5(written.cast("binary")), 1, 15), 16, 10).cast("long")
