"""Orders that depend on a seed and the key alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
