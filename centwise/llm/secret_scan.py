"""Secrets in texts: known shapes, and strings that a tokenizer packs badly."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from centwise.llm.tokens import rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The shapes of known secrets.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run of 24 or more, as [0-9a-f]+ kept at 24 or more
KINDS = ("assign", "access", "hex", "ratio")
#: Fixed value: the pattern that splits text before the merges of the rank file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A string is opaque if it has fewer characters for each token than this; words of any language have more.
LEAST_RATIO = 1.9
SHORTEST = 16

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_words = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_access, _hex = re.compile(ACCESS), re.compile(rf"(?<![0-9a-f]){HEX}")
_opaque = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Digests (MD5, SHA-1, SHA-224 to SHA-512 in hex) and identifiers (UUID, number, date and time) are no secrets.
_digest = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
_identifier = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9_+/=-]+|[0-9-]+T[0-9-]+Z?")
#: Words and short numbers joined by signs; the signs cost tokens, so the words are measured.
_joined, _word = re.compile(r"(?:[A-Za-z]{2,}|[0-9]{1,6})(?:[_/+=-]+(?:[A-Za-z]{2,}|[0-9]{1,6}))+"), re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, in code points."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _words):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, encode) -> list[tuple[int, int, int]]:
    """Strings of one shape of character that take many tokens; digests and identifiers left out."""
    found = []
    for m in _opaque.finditer(text):
        s = m[0]
        if _digest.fullmatch(s) or _identifier.fullmatch(s):
            continue
        parts = _word.findall(s) if _joined.fullmatch(s) else [s]
        if sum(map(len, parts)) < LEAST_RATIO * sum(len(encode(p)) for p in parts):
            found.append((m.start(), 3, m.end()))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_ratio for every row of ``docs`` (doc_id, text).

    Spans are kind:start:end, whole matches in code points, by start and then
    kind.  ``ratio`` spans come from the token-efficiency test and are added only
    where they are not inside a span of a known shape.  Null and empty texts have
    no spans (and the digest of an empty string); a null doc_id is passed
    through; repeated rows are scanned each; other columns are not looked at; no
    rows give no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in rows(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = [s for s in (opaque_spans(text, encode) if text else []) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
                counts = [sum(s[1] == kind for s in base) for kind in range(3)]
                out.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)), len(more)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_ratio"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_ratio bigint")
