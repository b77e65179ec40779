"""SentencePiece (merge type) encoding and decoding by a table of last tokens.

For every prefix of a text unit there is exactly one last token of its encoding. The table of these tokens is filled
from left to right: a dictionary automaton reports the pieces that end at a position, and a piece is the last token
there if it is compatible with the last token of the prefix before it. The ids are then recovered backwards.

* Units: a text is cut between two characters that no piece holds side by side (so around characters outside the
  vocabulary, too). No merge reaches across such a cut, so the units are encoded independently; short ones are looked up
  when they come again. The lookup is bounded: its older half goes when it is full.
* Pair compatibility: merging ``left + right`` must leave the border alone. The right edge of ``left`` and the left edge
  of ``right`` grow through known merges; the pair fails if a piece across the border would be merged before either
  edge moves on. Equal pieces merge leftmost first.
* Runs of two or more U+2581 have pieces of equal score, where the order of merges isn't a rank; such units run the
  plain merge agenda instead.

Null texts count as empty; an empty text has no tokens and decodes to an empty text. Rows are independent: repeated
rows give repeated results, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vialume.llm.text import Bytes, span_hashes, spans

SPACE = "▁"
#: Units kept for lookup, and the longest of them in bytes; beyond that they are encoded again.
KEPT_UNITS, KEPT_BYTES = 300_000, 64
#: Bytes of text whose units are looked up together.
TOGETHER = 2 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceTable:
    """Encoder and decoder for one model file."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.bytes = {b: i for i, b in self.byte_of.items()}
        normal = [i for i in range(size) if not (i in self.byte_of or i in self.silent or sp.is_unused(i) or i == self.unknown)]
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {self.pieces[i]: -sp.get_score(i) for i in normal}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.grows_right: dict[str, list[str]] = {}
        self.grows_left: dict[str, list[str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if piece.count(SPACE) > 1:
                continue
            out, made = self.agenda(piece, trace=True)
            if len(out) == 1:
                self.automaton.add_word(piece, (i, len(piece)))
                self.grows_right[piece] = self._edge(piece, made, 1)
                self.grows_left[piece] = self._edge(piece, made, 0)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        chars = sorted({c for p in self.ids for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int16)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        at = {c: k for k, c in enumerate(chars, 1)}
        self.apart = np.ones((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.apart[at[a], at[b]] = False
        #: The same for bytes of text with spaces; borders at bytes of longer characters stay whole.
        self.apart_bytes = np.zeros((256, 256), dtype=bool)
        ascii_class = self.classes[:128].copy()
        ascii_class[32] = at.get(SPACE, 0)
        self.apart_bytes[:128, :128] = self.apart[np.ix_(ascii_class, ascii_class)]

    def agenda(self, text: str, trace: bool = False):
        """Merge the best adjacent pair, leftmost first among equals, until none is left."""
        sym: list[str | None] = list(text)
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, heap, made = self.rank, [], {}

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (r := rank.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (r, a, b, len(sym[a]) + len(sym[b])))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or nxt[a] != b or len(sym[a]) + len(sym[b]) != size:
                continue
            if trace:
                made[a, size] = len(sym[a])
            sym[a], sym[b] = sym[a] + sym[b], None
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        out = [s for s in sym if s is not None]
        return (out, made) if trace else out

    def _edge(self, piece: str, made: dict, side: int) -> list[str]:
        """The pieces at one edge of ``piece`` while it grows, smallest first."""
        out, at, size = [piece], 0, len(piece)
        while size > 1:
            left = made[at, size]
            at, size = (at + left, size - left) if side else (at, left)
            out.append(piece[at : at + size])
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(self.pieces[a], self.pieces[b])
        return known

    def _compatible(self, a: str, b: str) -> bool:
        left, right, rank = self.grows_right[a], self.grows_left[b], self.rank
        i = j = 0
        never = float("inf")
        while True:
            next_a = rank[left[i + 1]] if i + 1 < len(left) else never
            next_b = rank[right[j + 1]] if j + 1 < len(right) else never
            across = rank.get(left[i] + right[j])
            if across is not None and across < next_a and across <= next_b:
                return False
            if next_a == never and next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _known_run(self, s: str) -> list[int]:
        n = len(s)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (i, length) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                p = last[before]
                if p < 0:
                    continue
                ok = pairs.get(p << 20 | i)
                if ok is None:
                    ok = compatible(p, i)
                if not ok:
                    continue
            last[end], size[end] = i, length
        if -1 in last[1:]:
            raise ValueError(f"no encoding for {s!r}")
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def parts(self, text: str) -> list[str]:
        """``text`` cut between characters that no piece holds side by side."""
        of = self.classes[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        cuts = (np.flatnonzero(self.apart[of[:-1], of[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def encode_unit(self, unit: str) -> list[int]:
        if self.chars.issuperset(unit) and SPACE + SPACE not in unit:
            return self._known_run(unit)
        out = []
        for part in self.parts(unit):
            if part[0] not in self.chars:
                out += [self.bytes[b] for b in part.encode()]
            elif part.startswith(SPACE + SPACE):
                out += [self.ids[p] for p in self.agenda(part)]
            else:
                out += self._known_run(part)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_unit(SPACE + text.replace(" ", SPACE)) if text else []

    def _pieces_to_text(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i >= 0 and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the one space that encoding puts in front goes."""
        text = self._pieces_to_text(ids)
        return text[1:] if text.startswith(" ") else text

    def known(self, units: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """For units of raw text with a space before each word: the decimal ids with a comma after each, and the text decoded from them."""
        if len(self.units) > KEPT_UNITS // 2:
            self.older, self.units = self.units, {}
        ids, texts, seen = [], [], self.units
        for u in units:
            v = seen.get(u)
            if v is None:
                v = self.older.get(u)
                if v is None:
                    found = self.encode_unit(u.decode().replace(" ", SPACE))
                    v = ("".join([f"{i}," for i in found]).encode(), self._pieces_to_text(found).encode())
                if len(u) <= KEPT_BYTES:
                    seen[u] = v
            ids.append(v[0])
            texts.append(v[1])
        return ids, texts

    def described(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """For each row of a text buffer: number of ids, the ids as decimal text, and the decoded text."""
        some = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[some], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        cut = np.ones(len(data) + 1, dtype=bool)
        if len(data):
            cut[1:-1] = self.apart_bytes[data[:-1], data[1:]]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        code, first = distinct_spans(data, edges[:-1], edges[1:])
        raw = data.tobytes()
        ids, texts = self.known([raw[i:j] for i, j in zip(edges[first].tolist(), edges[first + 1].tolist(), strict=True)])
        code, at = code.tolist(), np.searchsorted(edges, offsets).tolist()
        for i, j in zip(at[:-1], at[1:], strict=True):
            own = code[i:j]
            joined, decoded = b"".join([ids[c] for c in own]), b"".join([texts[c] for c in own])
            yield joined.count(b","), joined[:-1], decoded[1:] if decoded.startswith(b" ") else decoded


def distinct_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, the same for equal bytes alone, and the first span of each number.

    Spans are gathered by hash and compared byte by byte with the first of their hash; the rest are told apart plainly.
    """
    read = Bytes(data)
    code, known = pd.factorize(span_hashes(data, begin, end, 0, read))
    first = np.full(len(known), -1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    lead = first[code]
    unlike = np.flatnonzero((end - begin != end[lead] - begin[lead]) | ~read.same(begin, begin[lead], end - begin))
    more: dict[bytes, int] = {}
    for i in unlike.tolist():
        code[i] = more.setdefault(data[begin[i] : end[i]].tobytes(), len(known) + len(more))
    found = np.array([int(unlike[np.flatnonzero(code[unlike] == c)[0]]) for c in more.values()], dtype=np.int64)
    return code, np.concatenate([first, found])


_tables: dict[str, PieceTable] = {}


def piece_table(model: str) -> PieceTable:
    """The table of a model file, built once in a process."""
    if model not in _tables:
        _tables[model] = PieceTable(model)
    return _tables[model]


def _digests(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            n, ids, texts = [], [], []
            for _, _, data, offsets in spans(batch, most=TOGETHER):
                for count, joined, decoded in table.described(data, offsets):
                    n.append(count)
                    ids.append(hashlib.sha256(joined).hexdigest())
                    texts.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): number of ids, and digests of the ids and of the text decoded from them."""
    return docs.select("doc_id", "text").mapInArrow(_digests(model), SCHEMA)


def _id_lists(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi, data, offsets in spans(batch, most=TOGETHER):
                found = [(n, np.array(joined.split(b","), dtype=np.int32) if n else np.zeros(0, np.int32), hashlib.sha256(decoded).hexdigest()) for n, joined, decoded in table.described(data, offsets)]
                n, lists, texts = zip(*found, strict=True)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(n, pa.int64()), flat, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "token_ids", "decoded_sha256"])

    return run


def token_ids(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256) per row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_id_lists(model), "doc_id long, n_tokens long, token_ids array<int>, decoded_sha256 string")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with the ids of its texts as ``token_ids`` (array of int); other columns stay as they are."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "token_ids"]
    docs = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            ids = [table.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "token_ids"])

    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """``tokens`` (token_ids, further columns) with the decoded text as ``decoded``."""
    kept = [F.col(f"`{c}`") for c in tokens.columns if c != "decoded"]
    tokens = tokens.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            texts = [table.decode(t or []) for t in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))
