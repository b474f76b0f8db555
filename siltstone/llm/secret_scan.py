"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for strings in a sensitive context.

Candidates of the method are unbroken runs of `LEAST` or more key characters that start within `REACH` characters
after a sensitive word. Of a run with sensitive words inside, what follows the first and what follows the last of
them are candidates too, tried in this order until one is reported. A candidate is compressed with a raw zstandard
dictionary made of identifiers (common ones, and the `CORPUS_WORDS` that most texts of the corpus hold, found in one
pass over all rows) and of the text around it (without the string itself); the marginal bytes are its compressed
size less that of nothing. A string with a letter and a digit that costs at least `MIN_BYTES` and `MIN_RATE` bytes a
character is novel and is reported as `novel`, whole whatever its length. Spans do not overlap base spans.

Edge cases: null text counts as empty; empty text has no spans (digest of the empty string); spans are code
points, end exclusive; repeated rows each get their own row; an empty table gives an empty result; a column of the
table may have any name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.shipping import ship
from siltstone.llm.common import per_row, slices, tidy, utf8

KINDS = ("assign", "access", "hex", "novel")

#: The base patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Words of which one must be there for ASSIGN to match, in lower case.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SENSITIVE = re.compile(rb"(?i)password|passwd|passphrase|secret|token|api_?key|access_?key|private_?key|credential|bearer|authorization|client_?id")
#: What SENSITIVE looks for, as plain lower-case substrings.
SENSITIVE_WORDS = (b"passw", b"passphrase", b"secret", b"token", b"apikey", b"api_key", b"key", b"credential", b"bearer", b"authorization", b"client")
STRING = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
KEY_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")

#: Identifiers and placeholders that are no secrets.
IDENTIFIERS = b" ".join(
    b"password passwd secret token api_key apikey access_token refresh_token client_id client_secret private_key public_key "
    b"secret_key access_key authorization bearer credential credentials username user_name database connection_string "
    b"environment variable process.env os.environ getenv config.get settings your_password_here your_api_key_here "
    b"changeme placeholder example_token insert_token_here xxxxxxxxxxxxxxxx 00000000 12345678 abcdefgh ABCDEFGH "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 self.token request.headers response.data "
    b"get_secret_value password_hash token_type expires_in https://www.example.com/path/to/resource".split()
)
REACH, AROUND, LEAST, MIN_BYTES, MIN_RATE = 48, 1024, 12, 10, 0.45

#: Names of several words, which no random key is; the corpus's own go to the dictionary from CORPUS_DOCS texts on.
NAME = re.compile(rb"(?<![A-Za-z0-9_])[A-Za-z]+(?:_[A-Za-z]+)+(?![A-Za-z0-9_])")
CORPUS_WORDS, CORPUS_DOCS, NAME_BYTES, FLUSH, SLICE_BYTES = 500, 3, 64, 100_000, 1 << 22


def corpus_identifiers(df: DataFrame, text: str = "text") -> bytes:
    """The dictionary: IDENTIFIERS and the names that most texts hold, the most frequent last (nearest to the data)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

        for batch in batches:
            for raw in utf8(batch, text):
                if raw and b"_" in raw:
                    held.update({w for w in NAME.findall(raw) if len(w) <= NAME_BYTES})
            if len(held) > FLUSH:
                yield rows()
                held.clear()
        yield rows()

    found = df.select(text).mapInArrow(tidy(run), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= CORPUS_DOCS)
    top = found.orderBy(F.desc("n"), "w").limit(CORPUS_WORDS).collect()
    return b" ".join([IDENTIFIERS, *(bytes(r["w"]) for r in reversed(top))])


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind index) in bytes of the three base kinds, leftmost and non-overlapping within each."""
    spans = []
    low = raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw)]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    return spans


def novelty(candidate: bytes, around: bytes, identifiers: bytes = IDENTIFIERS) -> int:
    """Marginal compressed bytes of the candidate, given identifiers and the text around it."""
    prime = zstandard.ZstdCompressionDict(identifiers + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(candidate)) - len(packer.compress(b""))


def is_novel(raw: bytes, start: int, end: int, identifiers: bytes) -> bool:
    string = raw[start:end]
    if not (_DIGIT.search(string) and _LETTER.search(string)):
        return False
    cost = novelty(string, raw[max(0, start - AROUND) : start] + b"\n" + raw[end : end + AROUND], identifiers)
    return cost >= MIN_BYTES and cost >= MIN_RATE * (end - start)


def novel_spans(raw: bytes, taken: list[tuple[int, int, int]], identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """At most one span of each run of key characters; a run is tried three times at most, so the work is linear."""
    low = raw.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    ends = [m.end() for m in SENSITIVE.finditer(raw)]
    if not ends:
        return []
    out, taken = [], sorted(taken)
    bounds, last = [a for a, _, _ in taken], 0
    reach = list(accumulate((b for _, b, _ in taken), max))
    for at in ends:  # runs that start within reach of this word, or hold its end
        if at > last:
            last = max(last, _run_start(raw, at))
        while m := STRING.search(raw, last, at + REACH + LEAST):
            a = m.start()
            last = b = STRING.match(raw, a).end()
            i = bisect_right(ends, a)
            k = bisect_right(ends, b - LEAST)
            starts = [a] if i and a - ends[i - 1] <= REACH else []
            starts += [ends[j] for j in sorted({i, k - 1}) if i <= j < k]
            for start in starts:
                j = bisect_right(bounds, b - 1)
                if j and reach[j - 1] > start:
                    continue
                if is_novel(raw, start, b, identifiers):
                    out.append((start, b, 3))
                    break
    return out


def _run_start(raw: bytes, at: int) -> int:
    """Where the run of key characters that holds the byte before `at` begins."""
    while at and raw[at - 1] in KEY_BYTES:
        at -= 1
    return at


def code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points, by start and then kind; one walk over the text."""
    if raw.isascii() or not spans:
        return sorted(spans, key=lambda s: (s[0], s[2]))
    at, done, points = {}, 0, 0
    for offset in sorted({x for s in spans for x in s[:2]}):
        points += len(raw[done:offset].decode())
        at[offset], done = points, offset
    return sorted(((at[a], at[b], k) for a, b, k in spans), key=lambda s: (s[0], s[2]))


def find_secrets(raw: bytes, identifiers: bytes = IDENTIFIERS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and the method's own, in code points."""
    base = base_spans(raw)
    return code_points(raw, base), code_points(raw, novel_spans(raw, base, identifiers))


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per input row: `keep` columns, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    identifiers = corpus_identifiers(df, text)

    def row(raw: bytes) -> tuple:
        base, novel = find_secrets(raw, identifiers)
        n = [sum(s[2] == k for s in base) for k in range(3)]
        spans = sorted(base + novel, key=lambda s: (s[0], s[2]))
        return (*n, len(novel), hashlib.sha256(_named(base).encode()).hexdigest(), _named(spans))

    return per_row(df, keep, text, "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string", row)


def redacted(raw: bytes, identifiers: bytes = IDENTIFIERS, mark: bytes = b"<SECRET>") -> tuple[bytes, int]:
    """The text with every span (overlaps merged) replaced by the mark, and the number of spans."""
    base = base_spans(raw)
    spans = sorted(base + novel_spans(raw, base, identifiers))
    out, end = [], 0
    for a, b, _ in spans:
        if not out or a >= end:
            out += [raw[end:a], mark]
        end = max(end, b)
    return b"".join([*out, raw[end:]]), len(spans)


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "<SECRET>", n_chars: str | None = None) -> DataFrame:
    """All columns of df in their order, secrets in `text` replaced by `mark`; `n_chars`, if named, is the new length where
    the text changed. Null text stays null."""
    identifiers, schema = corpus_identifiers(df, text), df.schema
    kind = df.sparkSession.sparkContext.broadcast((identifiers, mark.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, put = kind.value
        for whole in batches:
            for batch in slices([whole], text, SLICE_BYTES):
                column = batch.schema.get_field_index(text)
                got = [(raw, 0) if raw is None else redacted(raw, words, put) for raw in utf8(batch, text)]
                if not any(n for _, n in got):
                    yield batch
                    continue
                out = batch.set_column(column, text, pa.array([x for x, _ in got], pa.binary()).cast(pa.string()))
                if n_chars is not None:
                    place = batch.schema.get_field_index(n_chars)
                    new = pc.utf8_length(out.column(column)).cast(batch.column(place).type)
                    out = out.set_column(place, n_chars, pc.if_else(pa.array([n > 0 for _, n in got], pa.bool_()), new, batch.column(place)))
                yield out

    return df.mapInArrow(tidy(run), schema)
