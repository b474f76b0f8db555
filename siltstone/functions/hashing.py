"""Digests, holdouts, stable hashes and token-span fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def holdout(digest: Column, modulus: int = 1000) -> Column:
    """The digest's first 8 bytes, big-endian and unsigned, are divisible by modulus."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % modulus == 0


def stable_hash(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *(p.cast("string") for p in parts)), 256)


def hash_bucket(digest: Column, buckets: int) -> Column:
    """The whole 256-bit digest modulo buckets, folded digit by digit."""
    digits = F.transform(F.filter(F.split(digest, ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % buckets)


#: Constants of the span fingerprint.
SPAN_FACTOR, SPAN_MIX_A, SPAN_MIX_B = 1_000_003, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def span_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of `width` token ids: a polynomial modulo 2^64, then mixed.

    The polynomial of every window is taken at once as a correlation of the ids with powers of the factor."""
    ids = np.asarray(ids, dtype=np.uint64) + np.uint64(1)
    if len(ids) < width:
        return np.empty(0, dtype=np.uint64)
    powers = np.array([pow(SPAN_FACTOR, width - 1 - k, 1 << 64) for k in range(width)], dtype=np.uint64)
    out = np.lib.stride_tricks.sliding_window_view(ids, width) @ powers
    for shift, factor in ((30, SPAN_MIX_A), (27, SPAN_MIX_B), (31, 1)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out


def span_fingerprints(ids: Column, width: int = 13, keep_one_in: int = 1) -> Column:
    """Distinct fingerprints as signed longs; of the unsigned values only multiples of keep_one_in."""

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            h = np.unique(span_hashes(np.array(x if x is not None else [], dtype=np.uint64), width))
            return h[h % np.uint64(keep_one_in) == 0].view(np.int64)

        return s.map(one)

    return run(ids)
