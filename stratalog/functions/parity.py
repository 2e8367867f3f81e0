"""Erasure parity over GF(2^8): k slices of a payload and m parity slices, any k of which give it back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: the field's polynomial.
POLYNOMIAL = 0x11D


def _logs() -> tuple[np.ndarray, np.ndarray]:
    """exp (twice over) and log to the base 2."""
    exp, log, x = np.zeros(512, dtype=np.uint8), np.zeros(256, dtype=np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x <<= 1
        x ^= POLYNOMIAL if x > 255 else 0
    return exp, log


EXP, LOG = _logs()


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, element by element."""
    a, b = np.asarray(a, dtype=np.uint8), np.asarray(b, dtype=np.uint8)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]]).astype(np.uint8)


def inverse(a: np.ndarray) -> np.ndarray:
    return EXP[255 - LOG[np.asarray(a)]]


def cauchy(m: int, k: int) -> np.ndarray:
    """Row i, column j: the inverse of i xor (m + j).  Every square part can be inverted."""
    if not (0 < k and 0 < m and k + m <= 256):
        raise ValueError("k and m are positive and at most 256 together")
    return inverse(np.arange(m)[:, None] ^ (m + np.arange(k))[None])


def product(matrix: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """matrix (r, c) times slices (c, n)."""
    out = np.zeros((len(matrix), slices.shape[1]), dtype=np.uint8)
    for j in range(matrix.shape[1]):
        out ^= times(matrix[:, j, None], slices[j][None])
    return out


def solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x with matrix x = right, by elimination on both at once."""
    both, n = np.concatenate([matrix, right], axis=1), len(matrix)
    for c in range(n):
        pivot = c + int(np.flatnonzero(both[c:, c])[0])
        both[[c, pivot]] = both[[pivot, c]]
        both[c] = times(both[c], inverse(both[c, c]))
        others = np.arange(n) != c
        both[others] ^= times(both[others, c][:, None], both[c][None])
    return both[:, n:]


def sliced(payload: bytes, k: int) -> np.ndarray:
    """The payload as k slices of one length, zeros at the end."""
    size = max(1, -(-len(payload) // k))
    return np.frombuffer(payload.ljust(k * size, b"\0"), dtype=np.uint8).reshape(k, size)


def protect(payload: bytes, k: int, m: int) -> tuple[np.ndarray, list[int]]:
    """Parity slices, and the checksums of data and parity slices."""
    data = sliced(payload, k)
    parity = product(cauchy(m, k), data)
    return parity, [zlib.crc32(s.tobytes()) for s in (*data, *parity)]


def repair(payload: bytes, length: int, k: int, parity: np.ndarray, checksums: list[int]) -> bytes | None:
    """The payload of the given length, damaged slices restored; None if more are damaged than parity slices are good."""
    m, data = len(parity), sliced(payload[:length].ljust(length, b"\0"), k).copy()
    bad = [j for j in range(k) if zlib.crc32(data[j].tobytes()) != checksums[j]]
    good = [i for i in range(m) if zlib.crc32(parity[i].tobytes()) == checksums[k + i]][: len(bad)]
    if len(good) < len(bad):
        return None
    if bad:
        matrix, kept = cauchy(m, k), [j for j in range(k) if j not in bad]
        right = parity[good] ^ product(matrix[np.ix_(good, kept)], data[kept])
        data[bad] = solved(matrix[np.ix_(good, bad)], right)
    return data.tobytes()[:length]


def recovery_records(table: DataFrame, key: str, k: int = 16, m: int = 2, column: str = "payload") -> DataFrame:
    """key, length, parity (m slices) and checksums of every payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, payload in zip(batch[key], batch[column], strict=True):
                if payload is not None:
                    parity, checksums = protect(bytes(payload), k, m)
                    rows.append((name, len(payload), [p.tobytes() for p in parity], checksums))
            yield pd.DataFrame(rows, columns=[key, "length", "parity", "checksums"])

    return table.select(key, column).mapInPandas(run, f"`{key}` {dict(table.dtypes)[key]}, length long, parity array<binary>, checksums array<long>")


def repaired(table: DataFrame, records: DataFrame, key: str, k: int = 16, column: str = "payload") -> DataFrame:
    """key and payload restored from recovery records; null where too much is damaged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [repair(bytes(p or b""), n, k, np.stack([np.frombuffer(s, dtype=np.uint8) for s in parity]), list(sums)) for p, n, parity, sums in zip(batch[column], batch["length"], batch["parity"], batch["checksums"], strict=True)]
            yield pd.DataFrame({key: batch[key], column: out})

    return table.select(key, column).join(records, key).mapInPandas(run, f"`{key}` {dict(table.dtypes)[key]}, {column} binary")
