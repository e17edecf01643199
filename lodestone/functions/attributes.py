"""Attribute objects as canonical JSON text, and a binary key in their value order."""

from __future__ import annotations

import json
import math
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import InvalidFormat


def _refuse(text: str):
    raise InvalidFormat(f"number {text} is not finite")


def canonical(text: str | None) -> str | None:
    """The object with sorted keys and no spaces; None where it is empty or null."""
    if not text:
        return None
    value = json.loads(text, parse_constant=_refuse)
    if not isinstance(value, dict):
        raise InvalidFormat("attributes are not an object")
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) if value else None


def _text(s: str) -> bytes:
    return s.encode().replace(b"\0", b"\0\xff") + b"\0\0"


def _key(v) -> bytes:
    """Null < bool < integer < unsigned < float < string < list < object; numbers by value, texts by bytes."""
    if v is None:
        return b"\1"
    if isinstance(v, bool):
        return b"\2" + bytes([v])
    if isinstance(v, int) and -(1 << 63) <= v < 1 << 63:
        return b"\3" + struct.pack(">Q", v + (1 << 63))
    if isinstance(v, int) and 0 <= v < 1 << 64:
        return b"\4" + struct.pack(">Q", v)
    if isinstance(v, (int, float)):
        bits = struct.unpack(">Q", struct.pack(">d", float(v)))[0]
        return b"\5" + struct.pack(">Q", bits ^ ((1 << 64) - 1) if bits >> 63 else bits | 1 << 63)
    if isinstance(v, str):
        return b"\6" + _text(v)
    if isinstance(v, list):
        return b"\7" + b"".join(b"\1" + _key(x) for x in v) + b"\0"
    return b"\x08" + b"".join(b"\1" + _text(k) + _key(x) for k, x in sorted(v.items(), key=lambda kv: kv[0].encode())) + b"\0"


def order_key(text: str | None) -> bytes:
    return _key(json.loads(text) if text else {})


@F.pandas_udf(T.StringType())
def canonical_json(col: pd.Series) -> pd.Series:
    return col.map(canonical, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def attribute_key(col: pd.Series) -> pd.Series:
    return pd.Series([order_key(x if isinstance(x, str) else None) for x in col])


def finite(x: float) -> bool:
    return math.isfinite(x)
