"""Deterministic per-row randomness from md5, identical in Spark SQL and ANSI engines.

A seeded RNG per task would change with partitioning and retries; an md5 of
(row key, salt) does not, so splits, folds and bootstrap weights survive
executor loss and re-planning, and can be checked by another SQL engine.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

TWO_32 = 4294967296.0
# e^-1 written out so every engine starts the Poisson(1) recursion from the same double.
EXP_MINUS_ONE = "0.36787944117144233D"


def uniform_sql(text_sql: str) -> str:
    """Uniform in [0, 1) from the first 32 bits of md5(text)."""
    return f"(CAST(conv(substr(md5({text_sql}), 1, 8), 16, 10) AS BIGINT) / {TWO_32}D)"


def hash_order_sql(text_sql: str) -> str:
    """A 60-bit ordering key from md5(text); ties broken by the caller's key."""
    return f"CAST(conv(substr(md5({text_sql}), 1, 15), 16, 10) AS BIGINT)"


def poisson1_cdf(support: int = 20) -> list[float]:
    """F(0..support-1) of Poisson(1) by the recurrence p_j = p_{j-1} / j, F_j = F_{j-1} + p_j,
    starting from e^-1 (the same double steps an SQL engine takes)."""
    p = c = float(EXP_MINUS_ONE.rstrip("D"))
    out = [c]
    for j in range(1, support):
        p = p / j
        c = c + p
        out.append(c)
    return out


def poisson1_sql(u_sql: str, support: int = 20) -> str:
    """Poisson(1) draw by inverse CDF of a uniform: min{k : u <= F(k)}.

    A CASE chain over the precomputed CDF (whole-stage codegen), not a
    higher-order function, because it runs once per row and replicate.
    """
    cdf = poisson1_cdf(support)
    whens = " ".join(f"WHEN {u_sql} <= {c!r}D THEN {k}" for k, c in enumerate(cdf))
    return f"(CASE {whens} ELSE {support} END)"


#: Constants and shifts of RFC 1321.
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)
_MD5_ADDED = np.array([int(abs(math.sin(i + 1)) * TWO_32) for i in range(64)], dtype=np.uint32)
_MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
#: Digests of so many texts are computed at a time (their words stay in a core's cache).
_MD5_TEXTS = 1 << 14


def md5_heads(begins: list[bytes], ends: list[bytes]) -> np.ndarray:
    """The first 32 bits of md5(begin + end), a row for each begin and a column for each end.

    Texts of up to 55 bytes are one block of md5, and are computed together
    as arrays; longer ones one by one.
    """
    out = np.empty((len(begins), len(ends)), dtype=np.uint32)
    rows, columns = {}, {}
    for lengths, texts in ((rows, begins), (columns, ends)):
        for i, text in enumerate(texts):
            lengths.setdefault(len(text), []).append(i)
    for n, at in rows.items():
        for m, of in columns.items():
            if n + m > 55:
                for i in at:
                    out[i, of] = np.frombuffer(b"".join(hashlib.md5(begins[i] + ends[j]).digest()[:4] for j in of), dtype=">u4")
                continue
            first = _words([begins[i].ljust(64, b"\0") for i in at])
            last = _words([bytes(n) + ends[j] + b"\x80" + bytes(55 - n - m) + (8 * (n + m)).to_bytes(8, "little") for j in of])
            step = max(1, _MD5_TEXTS // len(of))
            for k in range(0, len(at), step):
                out[np.ix_(at[k:k + step], of)] = _md5_blocks(first[k:k + step], last)
    return out


def _words(blocks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blocks), dtype="<u4").astype(np.uint32).reshape(-1, 16)


def _md5_blocks(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first word of md5 of each block ``first[i] | last[j]``; it is known three steps before the end."""
    shape = len(first), len(last)
    # a word that is empty on one side stays a row or a column
    words = [last[None, :, t] if not first[:, t].any() else first[:, t, None] if not last[:, t].any() else first[:, t, None] | last[None, :, t]
             for t in range(16)]
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in _MD5_START)
    spare = np.empty(shape, dtype=np.uint32)
    for i in range(61):
        kind = i // 16
        t = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        if kind < 2:  # (x & y) | (~x & z)
            x, y, z = ((b, c, d), (d, b, c))[kind]
            np.bitwise_xor(y, z, out=spare)
            spare &= x
            spare ^= z
        elif kind == 2:
            np.bitwise_xor(b, c, out=spare)
            spare ^= d
        else:
            np.invert(d, out=spare)
            spare |= b
            spare ^= c
        a += spare
        a += words[t] + _MD5_ADDED[i:i + 1]
        shift = _MD5_SHIFTS[kind][i % 4]
        np.right_shift(a, np.uint32(32 - shift), out=spare)
        a <<= np.uint32(shift)
        a |= spare
        a += b
        a, b, c, d = d, a, b, c
    return (b + _MD5_START[:1]).byteswap()
