"""Reed-Solomon coding and padded compression, in Arrow batches.

Arithmetic over GF(256) with the polynomial 0x11D; the code is systematic, its
parity rows are a Cauchy matrix, so any ``data`` of the fragments suffice.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int32), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    exp[255:510] = exp[:255]
    return exp, log


_EXP, _LOG = _tables()


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.broadcast_arrays(np.asarray(a, np.uint8), np.asarray(b, np.uint8))
    return np.where((a == 0) | (b == 0), 0, _EXP[_LOG[a] + _LOG[b]]).astype(np.uint8)


def _inverse(a: np.ndarray) -> np.ndarray:
    return _EXP[255 - _LOG[a]]


_PRODUCT = multiply(np.arange(256)[:, None], np.arange(256)[None, :])


def _matmul(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((m.shape[0], x.shape[1]), np.uint8)
    for i, row in enumerate(m):
        for c, values in zip(row, x, strict=True):
            if c == 1:
                out[i] ^= values
            elif c:
                out[i] ^= _PRODUCT[c][values]
    return out


@lru_cache
def generator(data: int, parity: int) -> np.ndarray:
    cauchy = _inverse((np.arange(data, data + parity)[:, None] ^ np.arange(data)[None, :]).astype(np.uint8))
    return np.concatenate([np.eye(data, dtype=np.uint8), cauchy])


@lru_cache(1024)
def _back(data: int, parity: int, have: tuple[int, ...]) -> np.ndarray:
    """The matrix that gives the data rows from the fragments ``have``; one per pattern of losses."""
    m, x = generator(data, parity)[list(have)].copy(), np.eye(data, dtype=np.uint8)
    for i in range(data):
        pivot = i + int(np.flatnonzero(m[i:, i])[0])
        m[[i, pivot]], x[[i, pivot]] = m[[pivot, i]], x[[pivot, i]]
        f = _inverse(m[i, i])
        m[i], x[i] = multiply(m[i], f), multiply(x[i], f)
        for j in range(data):
            if j != i and m[j, i]:
                c = m[j, i]
                m[j] ^= multiply(m[i], c)
                x[j] ^= multiply(x[i], c)
    return x


def encode(payload: bytes, data: int, parity: int) -> list[bytes]:
    size = -(-len(payload) // data)
    if not size:
        return [b""] * (data + parity)
    rows = np.frombuffer(payload.ljust(size * data, b"\0"), np.uint8).reshape(data, size)
    return [r.tobytes() for r in (*rows, *_matmul(generator(data, parity)[data:], rows))]


def decode(fragments: list[bytes | None], data: int, parity: int, length: int) -> bytes | None:
    """The payload from any ``data`` fragments; null if fewer are left.  Only lost data rows are computed."""
    have = tuple(i for i, f in enumerate(fragments) if f is not None)[:data]
    if len(have) < data:
        return None
    if not length:
        return b""
    lost = [i for i in range(data) if i not in have]
    if lost:
        rows = np.stack([np.frombuffer(fragments[i], np.uint8) for i in have])
        found = dict(zip(lost, _matmul(_back(data, parity, have)[lost], rows), strict=True))
        fragments = [found[i].tobytes() if i in found else fragments[i] for i in range(data)]
    return b"".join(bytes(f) for f in fragments[:data])[:length]


def ec_encode(data: int, parity: int):
    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def f(payloads: pd.Series) -> pd.Series:
        return pd.Series([encode(bytes(p), data, parity) for p in payloads])

    return f


def ec_decode(data: int, parity: int):
    @F.pandas_udf(T.BinaryType())
    def f(fragments: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([decode(list(x), data, parity, int(n)) for x, n in zip(fragments, lengths, strict=True)])

    return f


def compress_pad(multiple: int):
    """Raw deflate, padded with zeros to a multiple; the stream tells its own end."""
    if multiple < 1:
        raise ValueError("the padding must be positive")

    @F.pandas_udf(T.BinaryType())
    def f(payloads: pd.Series) -> pd.Series:
        out = []
        for p in payloads:
            packer = zlib.compressobj(wbits=-15)
            z = packer.compress(bytes(p)) + packer.flush()
            out.append(z.ljust(-(-len(z) // multiple) * multiple, b"\0"))
        return pd.Series(out)

    return f


def unpad_decompress(limit: int):
    """The payload again; null if it would be larger than ``limit``."""

    @F.pandas_udf(T.BinaryType())
    def f(payloads: pd.Series) -> pd.Series:
        out = []
        for p in payloads:
            body = zlib.decompressobj(wbits=-15).decompress(bytes(p), limit + 1)
            out.append(body if len(body) <= limit else None)
        return pd.Series(out)

    return f
