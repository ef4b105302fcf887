"""Reproducible pseudo-random keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def hash_key(identity: Column, salt: str) -> Column:
    """A whole number below 2^32 that depends only on the salt and the row's identity."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), identity.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
