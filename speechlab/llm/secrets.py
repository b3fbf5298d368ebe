"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Fixed kinds: ``assign`` (a keyword set to a value of 6+ characters), ``access`` (AKIA keys of
20+ characters), ``hex`` (24+ lower-case hex digits); leftmost matches that do not overlap
within a kind, matches that are too short dropped. The fourth kind, ``token``, is a run of
20+ letters, digits and ``+/_=-`` with a letter in it, of few characters per token under a
tiktoken vocabulary (random strings compress badly), unless it is a known digest (hex of 32, 40,
56, 64, 96 or 128 digits), an UUID, or an identifier: parts that look like words or numbers, the
words together of no fewer characters per token (what separates parts costs tokens too). Spans are code points of the text, the end exclusive.

Defined results: null or empty text has no span; repeated rows are scanned alike; spans that
start together are ordered as the kinds are listed; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "token")
#: Fewer characters per token than this make a string random.
RATIO = 2.2

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_MARK = re.compile(r"""(?ai:passw|secret|token|api_?key)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})\Z")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a vocabulary file, read once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _known(run: str) -> bool:
    """UUIDs and digests."""
    return bool(_UUID.match(run) or len(run) in _DIGEST_SIZES and _DIGEST.match(run))


def _identifier(run: str, encode, ratio: float) -> bool:
    """Whether the parts are words or numbers by their shape, and the words are efficient under the vocabulary."""
    parts = [x for x in re.split(r"[+/_=-]+", run) if x]
    if not all(_WORDS.match(x) for x in parts):
        return False
    words = [x for x in parts if not x.isdigit()]  # any number has about the same ratio
    return sum(map(len, words)) >= ratio * sum(len(encode(x)) for x in words)


def spans(text: str | None, encode, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of every span of a text, in order."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    if (":" in text or "=" in text) and _ASSIGN_MARK.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _RUN.finditer(text):
        run = m[0]
        if any(c.isalpha() for c in run) and not _known(run):
            if len(run) < ratio * len(encode(run)) and not _identifier(run, encode, ratio):
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def scan(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", ratio: float = RATIO) -> DataFrame:
    """``key``, the spans of every whole text as ``found`` (array of kind, start, end), in order.

    vocabulary: path of a tiktoken rank file that every executor has; pattern: its word pattern.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for value in batch.column(1):
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(value.as_py(), encode, ratio)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[key, "found"])

    of = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {of}, found array<struct<kind: string, start: bigint, end: bigint>>")


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def base_digest(found: list[tuple[str, int, int]]) -> str:
    """The digest of the spans of fixed kinds (the query computes the same with SQL functions)."""
    return hashlib.sha256(joined([x for x in found if x[0] != "token"]).encode()).hexdigest()
