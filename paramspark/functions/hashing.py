"""Hash families. ``portable`` gives the same numbers in any SQL engine; the others equal well-known hash functions bit by bit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType


def portable(key: Column, i: int | Column) -> Column:
    """60 bits of md5 of ``key:i`` as a non-negative long."""
    text = F.concat_ws(":", key.cast("string"), (F.lit(i) if isinstance(i, int) else i).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(key: Column, i: int | Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) for a key, index and seed."""
    return portable(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), i) / float(16**15)


def java_string_hash(text: str) -> int:
    """The 32-bit polynomial hash over UTF-16 units, signed."""
    h = 0
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (31 * h + unit) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def _rotate(x: int, n: int) -> int:
    return (x << n | x >> (32 - n)) & 0xFFFFFFFF


# The multipliers and shifts below are fixed values of 32-bit Murmur3.
def _murmur_mix(k: int) -> int:
    return _rotate(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF


def murmur3_utf16(text: str, seed: int) -> int:
    """32-bit Murmur3 over pairs of UTF-16 units (high unit first), signed."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
    h = seed & 0xFFFFFFFF
    for a, b in zip(units[::2], units[1::2]):
        h = (_rotate(h ^ _murmur_mix((a << 16) + b & 0xFFFFFFFF), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if len(units) % 2:
        h ^= _murmur_mix(units[-1])
    h ^= len(units)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def xx64_long(value: int, seed: int) -> int:
    """XXH64 of the 8 little-endian bytes of a long, signed."""
    h = xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), seed & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of texts, one row each padded with zeros, and their numbers."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(x) // 2 for x in raw), np.int64, len(raw))
    width = int(sizes.max(initial=0))
    table = np.zeros((len(raw), width), "<u2")
    table[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(raw), "<u2")
    return table.astype(np.uint32), sizes


def _in_blocks(texts: list[str], function: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """``function`` over texts of like length together, so that padding stays small."""
    order = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
    out = np.zeros((len(texts), width), np.int64)
    for at in range(0, len(order), 1024):
        some = order[at : at + 1024]
        out[some] = function(*_units([texts[i] for i in some.tolist()])).reshape(len(some), width)
    return out


def _rotate_all(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def _mix_all(k: np.ndarray) -> np.ndarray:
    return _rotate_all(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def murmur3_utf16_all(texts: list[str], seeds: int) -> np.ndarray:
    """``murmur3_utf16`` of each text (rows) under the seeds 0 to ``seeds`` - 1 (columns), a unit of all texts at a time."""

    def block(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = np.tile(np.arange(seeds, dtype=np.uint32), (len(units), 1))
        for j in range(0, units.shape[1] - 1, 2):
            mixed = _mix_all((units[:, j] << np.uint32(16)) + units[:, j + 1])
            now = _rotate_all(h ^ mixed[:, None], 13) * np.uint32(5) + np.uint32(0xE6546B64)
            h = np.where((sizes > j + 1)[:, None], now, h)
        odd = np.flatnonzero(sizes % 2)
        h[odd] ^= _mix_all(units[odd, sizes[odd] - 1])[:, None]
        h ^= sizes.astype(np.uint32)[:, None]
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64)

    return _in_blocks(texts, block, seeds)


# Fixed values of 64-bit XXH: its five primes.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def xx64_all(values: np.ndarray, seeds: int) -> np.ndarray:
    """``xx64_long`` of each value (rows) under the seeds 0 to ``seeds`` - 1 (columns)."""
    p1, p2, p3, p4 = (np.uint64(p) for p in (_P1, _P2, _P3, _P4))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    k = turn(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = (np.arange(seeds, dtype=np.uint64) + np.uint64(_P5) + np.uint64(8))[None, :] ^ k[:, None]
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def java_string_hash_all(texts: list[str]) -> np.ndarray:
    """``java_string_hash`` of each text, a unit of all texts at a time."""

    def block(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(units), np.uint32)
        for j in range(units.shape[1]):
            h = np.where(sizes > j, h * np.uint32(31) + units[:, j], h)
        return h.view(np.int32).astype(np.int64)

    return _in_blocks(texts, block, 1)[:, 0]


@F.pandas_udf(ArrayType(LongType()))
def _murmur_family(ids: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(list(murmur3_utf16_all(["" if x is None else str(x) for x in ids], int(n.iloc[0]) if len(n) else 0)))


@F.pandas_udf(ArrayType(LongType()))
def _xx_family(ids: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(list(xx64_all(ids.fillna(0).to_numpy(np.int64), int(n.iloc[0]) if len(n) else 0)))


@F.pandas_udf(IntegerType())
def java_hash(text: pd.Series) -> pd.Series:
    found = pd.Series(java_string_hash_all(text.fillna("").tolist()), text.index, "Int32")
    return found.mask(text.isna())


def family(key: Column, n: int, name: str = "portable") -> Column:
    """``n`` hashes of a key as an array: ``portable``, ``murmur3`` (of the key's text) or ``xx64`` (of a long key)."""
    if name == "portable":
        return F.array(*(portable(key, i) for i in range(n)))
    if name == "murmur3":
        return F.when(key.isNotNull(), _murmur_family(key.cast("string"), F.lit(n)))
    if name == "xx64":
        return F.when(key.isNotNull(), _xx_family(key.cast("long"), F.lit(n)))
    raise ValueError(f"unknown hash family {name!r}")


def pack_bits(hashes: Column, n: int) -> Column:
    """The lowest bits of an array of hashes as ``n`` values of -1 or 1, 32 of each hash."""
    bit = lambda j: F.shiftrightunsigned(F.get(hashes, F.lit(j // 32)), j % 32).bitwiseAND(F.lit(1).cast("long"))
    return F.array(*((2 * bit(j) - 1).cast("int") for j in range(n)))
