"""Novel strings of any length, against a search that looks at every run and every sensitive word, and clashing columns."""

import re
import time

import numpy as np
import pytest

from siltstone.llm import secret_scan


@pytest.mark.parametrize("gap, size", [(1, 12), (1, 4200), (48, 9000), (48, 16), (49, 16)])
def test_whole_string_is_a_span(gap, size):
    rng = np.random.default_rng(size)
    letters = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)
    string = "Z1" + rng.choice(letters, size - 2).tobytes().decode()
    text = "the token" + " " * gap + string + " and the rest"
    _, novel = secret_scan.find_secrets(text.encode())
    assert novel == ([(9 + gap, 9 + gap + size, 3)] if gap <= secret_scan.REACH else [])


def slow_spans(raw, taken):
    """Every maximal run with every sensitive word of the text, one by one."""
    words = [(m.start(), m.end()) for m in secret_scan.SENSITIVE.finditer(raw)]
    out = []
    for m in re.finditer(rb"[A-Za-z0-9+/_=-]+", raw):
        a, b = m.span()
        if b - a < 12:
            continue
        inside = [e for _, e in words if a < e <= b - 12]
        starts = [a] if any(0 <= a - e <= 48 for _, e in words) else []
        starts += inside[:1] + (inside[-1:] if len(inside) > 1 else [])
        for s in starts:
            if any(x < b and s < y for x, y, _ in taken):
                continue
            string = raw[s:b]
            cost = secret_scan.novelty(string, raw[max(0, s - 1024) : s] + b"\n" + raw[b : b + 1024])
            if cost >= 10 and cost >= 0.45 * len(string) and re.search(rb"[0-9]", string) and re.search(rb"[A-Za-z]", string):
                out.append((s, b, 3))
                break
    return out


def test_against_every_run():
    rng = np.random.default_rng(9)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    found = 0
    for _ in range(300):
        parts = []
        for _ in range(rng.integers(1, 14)):
            kind = rng.integers(0, 7)
            key = "".join(rng.choice(alphabet, rng.integers(8, 40)))
            parts.append(["token", "secret ", "the api_key", " some words here ", key, "password = " + key, " " * int(rng.integers(1, 60))][kind])
        raw = "".join(parts).encode()
        base = secret_scan.base_spans(raw)
        got = secret_scan.novel_spans(raw, base)
        assert got == slow_spans(raw, base), raw
        found += len(got)
    assert found > 100


def test_time_is_linear_in_sensitive_words():
    began = time.perf_counter()
    for text in ("token " * 200_000, "token" * 200_000, "secret_token=" * 80_000 + "Zx81kPq02LmVw7Tn"):
        secret_scan.find_secrets(text.encode())
    assert time.perf_counter() - began < 30


def test_corpus_names_are_no_secrets(spark):
    name = "internal_billing_reconciliation_worker"
    df = spark.createDataFrame([(i, f"text {i} with the {name} in it") for i in range(4)] + [(9, None)], "doc_id long, text string")
    words = secret_scan.corpus_identifiers(df)
    assert name.encode() in words and secret_scan.IDENTIFIERS in words
    string = (name + "_v2").encode()
    assert secret_scan.novelty(string, b"", words) < secret_scan.novelty(string, b"") / 2


def test_redaction_and_clashing_columns(spark):
    rows = [(1, "the secret key is Zx81kPq02LmVw7Tn today", 40, 5, "a", True), (2, "no secret", None, 6, "b", None), (3, None, 1, 7, None, False), (4, "password = hunter2xyz é", 23, 1, "c", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, n_spans int, __redacted string, __text_null boolean")
    got = secret_scan.redact_secrets(df, n_chars="n_chars")
    assert got.columns == df.columns and got.dtypes == df.dtypes
    out = {r["doc_id"]: r for r in got.collect()}
    assert (out[1]["text"], out[1]["n_chars"], out[1]["n_spans"], out[1]["__redacted"]) == ("the secret key is <SECRET> today", 32, 5, "a")
    assert tuple(out[2]) == rows[1] and tuple(out[3]) == rows[2]
    assert (out[4]["text"], out[4]["n_chars"]) == ("<SECRET> é", 10)
