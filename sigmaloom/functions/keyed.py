"""Keyed partitions: HMAC-SHA256 of a unit's token, as a pure expression, compared with public thresholds.

The key is the secret of a site; the domain separates uses. A unit's place depends on its token only: not on the
order of rows, their number, or how they are partitioned. Row units need a declared key, as Spark has no row order.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: bytes) -> tuple[str, str]:
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex; message: binary or text in UTF-8."""
    inner, outer = _pads(key)
    pad = lambda p: F.unhex(F.lit(p))
    return F.sha2(F.concat(pad(outer), F.unhex(F.sha2(F.concat(pad(inner), message.cast("binary")), 256))), 256)


def hmac_bytes(key: bytes, message: bytes) -> bytes:
    return hmac.new(key, message, hashlib.sha256).digest()


def token(kind: str, unit: Column, domain: str) -> Column:
    """domain, the kind of unit, and the unit's own text, framed so that no two of them run together."""
    text = unit.cast("string")
    return F.concat(F.lit(f"{domain}\0{kind}\0"), F.lpad(F.hex(F.octet_length(text)), 8, "0"), text)


def threshold_hex(numerator: int, denominator: int) -> str:
    """numerator / denominator of 2^256, in 64 hex digits."""
    return f"{numerator * (1 << 256) // denominator:064x}"


def holdout(key: bytes, unit: Column, numerator: int, denominator: int = 1_000_000, kind: str = "subject", domain: str = "holdout/v1") -> Column:
    """Whether the unit is in the test side. The fraction is no part of the token: smaller test sides lie in larger ones."""
    if not 0 < numerator < denominator:
        raise ValueError("the test fraction must be between 0 and 1")
    return F.lower(hmac_hex(key, token(kind, unit, domain))) < F.lit(threshold_hex(numerator, denominator))


def fold(key: bytes, unit: Column, folds: int, kind: str = "subject", domain: str = "folds/v1") -> Column:
    """1 to folds, by exact comparison with folds - 1 thresholds."""
    if not 2 <= folds <= 10:
        raise ValueError("2 to 10 folds")
    h = F.lower(hmac_hex(key, token(kind, unit, domain)))
    out = F.lit(1)
    for k in range(1, folds):
        at = -(-k * (1 << 256) // folds)
        out = out + (h >= F.lit(f"{at:064x}")).cast("int")
    return out


def block(key: bytes, unit: Column, blocks: int, domain: str = "block/v1") -> Column:
    """0 to blocks - 1, by the first 60 bits modulo blocks."""
    if not 2 <= blocks <= 64:
        raise ValueError("2 to 64 blocks")
    return F.pmod(F.conv(F.substring(hmac_hex(key, token("subject", unit, domain)), 1, 15), 16, 10).cast("long"), F.lit(blocks)).cast("int")


def tree_of(key: bytes, bins: list[Column], target: Column, trees: int, domain: str = "tree/v1") -> Column:
    """The tree that a record trains: equal records train the same tree."""
    parts = F.concat_ws(",", *[F.coalesce(b.cast("string"), F.lit("-")) for b in bins], target.cast("string"))
    return F.pmod(F.conv(F.substring(hmac_hex(key, token("record", parts, domain)), 1, 15), 16, 10).cast("long"), F.lit(trees)).cast("int")


def in_step(key: bytes, unit: Column, step: Column, steps: int, domain: str = "poisson/v1") -> Column:
    """Poisson sampling: each unit is in each step with chance 1 / steps, independently."""
    message = F.concat_ws(":", step.cast("string"), unit.cast("string"))
    return F.lower(hmac_hex(key, token("step", message, domain))) < F.lit(threshold_hex(1, steps))


def ranked_features(schema_sha256: str, features: int, take: int, release: int, domain: str = "features/v1") -> list[int]:
    """A public balanced subset of features: the `take` smallest by hash, in order."""
    by = sorted(range(features), key=lambda f: hashlib.sha256(f"{domain}\0{schema_sha256}\0{release}\0{f}".encode()).digest())
    return sorted(by[:take])
