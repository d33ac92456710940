"""Content hashes that Spark has no expression for, Arrow-batched."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

C4_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def c4(data: bytes) -> str:
    """SHA-512 in base 58, 88 digits, after the letters c4."""
    n, out = int.from_bytes(hashlib.sha512(data).digest(), "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = C4_ALPHABET[r] + out
    return "c4" + out.rjust(88, C4_ALPHABET[0])


def _hashed(content: Column, one: Callable[[bytes], str]) -> Column:
    """One string a value, in Arrow batches; the function is made when used, as workers import this module too."""

    def batch(values):
        return values.map(lambda x: None if x is None else one(bytes(x)))

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")(content)


def xxh3_asset(content: Column | str) -> Column:
    """Asset id of bytes: xxh3-128 in lower hex."""
    return _hashed(content, lambda x: f"xxh3:{xxhash.xxh3_128_hexdigest(x)}")


def xxh64_hex(content: Column | str) -> Column:
    return _hashed(content, xxhash.xxh64_hexdigest)


def c4_id(content: Column | str) -> Column:
    return _hashed(content, c4)
