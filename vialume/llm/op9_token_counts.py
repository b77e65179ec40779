"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole, with a byte-level BPE; the bytes of its tokens are the bytes of the text, so
running lengths give every token's span. Sections are the lines of a text (a line end belongs to the line it ends), or
with ``fields`` the document is these columns, each but the last ended by a line feed that belongs to it, and a section
is a field (of some other type: its text; null: empty). Token spans and section spans are both sorted, so the interval join is a binary search.
A token that crosses a border is allocated by rule: ``first`` to the section of its first byte, ``most`` to the section
with most of its bytes (the earlier of equals), ``split`` to each section by its share of bytes.

Null and empty texts have no sections and give no rows; an empty last field is a section without tokens. Rows are independent; repeated rows give repeated results, and
further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialume.llm.text import spans

SCHEMA = "doc_id long, section int, begin_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"
RULES = ("first", "most", "split")

_encodings: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(ranks_file: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file and the byte length of each token; loaded once in a process."""
    if ranks_file not in _encodings:
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            length[i] = len(token)
        _encodings[ranks_file] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length
    return _encodings[ranks_file]


def allocate(ends: np.ndarray, borders: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross its end. ends: of token spans; borders: of sections, 0 first."""
    begins = np.concatenate([[0], ends[:-1]])
    n = len(borders) - 1
    a = np.searchsorted(borders, begins, side="right") - 1
    b = np.searchsorted(borders, ends, side="left") - 1
    crossing = np.flatnonzero(b > a)
    counts = np.bincount(a, minlength=n).astype(np.float64)
    if rule != "first":
        for t in crossing.tolist():
            parts = np.minimum(borders[a[t] + 1 : b[t] + 2], ends[t]) - np.maximum(borders[a[t] : b[t] + 1], begins[t])
            counts[a[t]] -= 1
            if rule == "most":
                counts[a[t] + int(parts.argmax())] += 1
            else:
                counts[a[t] : b[t] + 1] += parts / (ends[t] - begins[t])
    return counts, np.bincount(a[crossing], minlength=n)


def line_borders(raw: np.ndarray) -> np.ndarray:
    """Byte positions at which the lines of a text begin, and its end."""
    inner = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], inner[inner < len(raw)], [len(raw)]])


def section_tokens(docs: DataFrame, ranks_file: str, pattern: str, rule: str = "first", fields: list[str] | None = None) -> DataFrame:
    """One row for each section of each row of ``docs`` (doc_id, and text or ``fields``)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if fields is not None:
        parts = [F.concat(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("" if k + 1 == len(fields) else "\n")) for k, c in enumerate(fields)]
        docs = docs.select("doc_id", F.concat(*parts).alias("text"), F.array(*[F.octet_length(p) for p in parts]).alias("sizes"))
    else:
        docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, length = encoding(ranks_file, pattern)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            sizes = batch.column("sizes").to_pylist() if fields is not None else None
            for lo, _, data, offsets in spans(batch):
                out: list[tuple] = []
                for k in range(len(offsets) - 1):
                    raw = data[offsets[k] : offsets[k + 1]]
                    if not len(raw):
                        continue
                    ends = np.cumsum(length[np.array(enc.encode_ordinary(raw.tobytes().decode()), dtype=np.int64)])
                    borders = line_borders(raw) if sizes is None else np.cumsum([0, *sizes[lo + k]])
                    counts, crossing = allocate(ends, borders, rule)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[borders]
                    out.append((np.full(len(counts), lo + k), np.arange(len(counts)), chars[:-1], chars[1:], counts, crossing, np.full(len(counts), len(ends))))
                if out:
                    row, section, begin, end, counts, crossing, total = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row.tolist()], pa.int64()), pa.array(section, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64()), pa.array(total, pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)
