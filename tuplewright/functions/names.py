"""Expressions on names and keys."""

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def type_of(name: Column) -> Column:
    """The part before the first colon; '' without one."""
    return F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise(F.lit(""))


def id_of(name: Column) -> Column:
    """The part after the first colon; the whole name without one."""
    return F.when(F.contains(name, F.lit(":")), F.substr(name, F.instr(name, ":") + 1)).otherwise(name)


def joined(kind: Column, rest: Column) -> Column:
    return F.when(kind == "", rest).otherwise(F.concat(kind, F.lit(":"), rest))


def pseudonym(name: Column, salt: bytes) -> Column:
    """erased: and 16 hex digits of the salted SHA-256 of the name's UTF-8."""
    return F.concat(F.lit("erased:"), F.substring(F.sha2(F.concat(F.lit(bytearray(salt)), F.encode(name, "UTF-8")), 256), 1, 16))


def hash_key(key) -> int:
    """The 64-bit key of an int (itself), or of text or bytes (BLAKE2b-8, little-endian, signed)."""
    if isinstance(key, bool) or not isinstance(key, int | str | bytes | bytearray | memoryview):
        raise TypeError(f"a key is an int, str or bytes, not {type(key).__name__}")
    if isinstance(key, int):
        if not -(2**63) <= key < 2**63:
            raise ValueError(f"key out of the signed 64-bit range: {key}")
        return key
    data = key.encode() if isinstance(key, str) else bytes(key)
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


@F.pandas_udf(T.LongType())
def hash_text(keys: pd.Series) -> pd.Series:
    """hash_key of a string column, in Arrow batches: Spark has no BLAKE2b."""
    return keys.map(hash_key, na_action="ignore").astype("Int64")
