"""Tenant-keyed masking of metadata values: enc:v1:{key id}:{hex}. It hides values from a glance; it is no encryption to rely on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _xor(data: bytes, key: bytes) -> bytes:
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(data))


def seal(tenant: str, key_id: str, secret: str, text: str) -> str:
    return f"enc:v1:{key_id}:{_xor(f'{tenant}\0{text}'.encode(), secret.encode()).hex()}"


def unseal(tenant: str, keys: dict[str, str], value: str) -> str:
    _, _, key_id, data = value.split(":", 3)
    if key_id not in keys:
        raise KeyError(f"no key {key_id}")
    owner, text = _xor(bytes.fromhex(data), keys[key_id].encode()).decode().split("\0", 1)
    if owner != tenant:
        raise PermissionError("the value belongs to another tenant")
    return text


def rotated(value: Column, tenant: str, keys: dict[str, str], to: str) -> Column:
    """Sealed values under the key `to`; others, and those under it already, stay."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        old = lambda v: isinstance(v, str) and v.startswith("enc:v1:") and not v.startswith(f"enc:v1:{to}:")
        return s.map(lambda v: seal(tenant, to, keys[to], unseal(tenant, keys, v)) if old(v) else v)

    return run(value)
