"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document. Two suffixes that share their first ``window`` words meet in
an internal node at least that deep; every occurrence but the first (smallest doc_id, then start) is a repeat, and the
words that repeats cover are removed.

1. Prefixes. In each window one suffix stands for it: that whose first ``PREFIX`` words have the smallest hash (leftmost
   of equals), which equal windows choose alike. Neighbouring windows mostly share it, so suffixes come in short runs.
2. Vertical partitioning. Prefixes are tallied over all texts in 2^20 counters. A prefix whose counter stays under the
   bound of a group keeps its length; its suffixes are counted, and a prefix that occurs once has no internal node below
   it and needs no tree. A prefix beyond the bound is lengthened to the whole window, so its suffixes spread over as many
   groups as it has continuations. The number of groups follows from the tally: each has about ``GROUP_ROWS`` runs.
3. Subtrees. A group holds the runs of its prefixes: for each the place, and for each suffix in it the code of its path
   down to the window's depth. Sorted by prefix and path, the nodes at that depth are runs of equal codes. Prefix and
   path, or two lanes for lengthened prefixes, make 128 bits. Occurrences that share a node in one slice of text are merged
   before the shuffle, and those of lengthened prefixes are merged again in ``SALTS`` parts before they meet, so a passage
   that every document has leaves no large group.
4. Repeats go back to their documents as runs of starts, where they become spans of removed words. ``repeats`` gives them
   as maximal repeats instead: neighbouring nodes with the same displacement to the first occurrence, joined.

Texts are shuffled once; the two joins share that exchange. Only the counters (4 MB) reach the driver.

Null texts have no words. Null doc_ids come before all others. Rows with the same doc_id and text occupy the same places,
so neither removes the other; rows with the same doc_id and other texts are ordered by the texts' 64-bit hashes. A text is
handled whole, at some 30 bytes of memory for each of its own; texts of some 40 MB need larger executors. Empty tables
give empty results. Further columns stay as they are in ``dedup`` and are ignored in ``digests``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vialume.llm.counters import slots, tally
from vialume.llm.frames import own_names
from vialume.llm.text import Words, mix, span_hashes, spans

WINDOW, PREFIX = 20, 8
NULL_ID = -(1 << 63)
COUNTERS = 1 << 20
#: Runs that a group is meant for, and occurrences beyond which a prefix is lengthened.
GROUP_ROWS, MOST_OCCURRENCES = 250_000, 50_000
#: Parts in which the occurrences of lengthened prefixes are merged before they meet.
SALTS = 256


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    kind, values = np.dtype(kind), column.to_pylist()
    if kind.kind != "i":
        return np.frombuffer(b"".join(values), dtype=kind)
    parts = [np.frombuffer(v, dtype=np.uint8).reshape(kind.itemsize, -1).T for v in values]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.zeros(0, kind)


def _cut(a: np.ndarray, at: np.ndarray) -> pa.Array:
    """The ranges of ``a`` between the bounds ``at`` as binary values; signed numbers are stored plane by plane, so that
    the shuffle's compression sees their zeros."""
    a = np.ascontiguousarray(a)
    ranges = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
    if a.dtype.kind == "i":
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize)
        return pa.array([planes[i:j].T.tobytes() for i, j in ranges], pa.binary())
    raw, w = a.tobytes(), a.dtype.itemsize
    return pa.array([raw[i * w : j * w] for i, j in ranges], pa.binary())


def _changes(*arrays: np.ndarray) -> np.ndarray:
    """The first of each run of equal rows, and the number of rows."""
    n = len(arrays[0])
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = False
    for a in arrays:
        new[1:n] |= a[1:] != a[:-1]
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


class Suffixes:
    """The windows of a slice: where each starts, and the place and hash of the prefix that stands for it."""

    def __init__(self, words: Words, window: int = WINDOW, prefix: int = PREFIX):
        n, row = len(words), words.rows()
        starts = np.arange(max(0, n - window + 1))
        self.start = starts[row[: len(starts)] == row[window - 1 :]] if len(starts) else starts
        self.row = row
        if not len(self.start):
            self.at, self.prefix = self.start, np.zeros(0, np.uint64)
            return
        h = np.zeros(n - prefix + 1, dtype=np.uint64)
        for j in range(prefix):
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h += words.hash[j : j + len(h)]
        mix(h)
        best, at = h[self.start], self.start.copy()
        for j in range(1, window - prefix + 1):
            other = h[self.start + j]
            less = np.flatnonzero(other < best)
            best[less] = other[less]
            at[less] = self.start[less] + j
        self.at, self.prefix = at, best

    def paths(self, codes: np.ndarray, who: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """The code of the path of these windows, from the codes of words."""
        h = np.zeros(len(who), dtype=np.uint64)
        for j in range(window):
            h *= np.uint64(0x9FB21C651E98DF25)
            h += codes[self.start[who] + j]
        return mix(h)


def _group_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def _run_prefixes(window: int):
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in spans(batch):
            s = Suffixes(Words(data, offsets), window)
            yield s.prefix[_changes(s.at)[:-1]]

    return hashes


def _prefixes(n: int, window: int, frequent):
    """Entries (prefix, document, whether twice in it) by group; a document with frequent prefixes has one entry for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = np.unpackbits(frequent.value).view(bool)
        for batch in batches:
            key, variant = (np.asarray(batch.column(c)) for c in ("key", "variant"))
            for lo, _, data, offsets in spans(batch):
                s = Suffixes(Words(data, offsets), window)
                first = _changes(s.at)[:-1]
                doc, h = s.row[s.at[first]], s.prefix[first]
                often = crowd[slots(h, COUNTERS)]
                h = np.where(often, np.uint64(0), h)
                order = np.lexsort((doc, h))
                doc, h, often = doc[order], h[order], often[order]
                at = _changes(h, doc)
                often, at = often[at[:-1]] | (np.diff(at) > 1), at[:-1]
                doc, h = doc[at], h[at]
                group = _group_of(np.where(h == 0, mix((key[lo + doc] ^ variant[lo + doc]).view(np.uint64)), h), n)
                order = np.argsort(group, kind="stable")
                doc, h, often, group = doc[order], h[order], often[order], group[order]
                at = _changes(group)
                yield pa.RecordBatch.from_arrays([pa.array(group[at[:-1]], pa.int32()), *(_cut(x, at) for x in (h, key[lo + doc], variant[lo + doc], often))], ["group", "h", "key", "variant", "often"])

    return run


def _repeated_prefixes(table: pa.Table) -> pa.Table:
    h, key, variant, often = (_joined(table.column(c), k) for c, k in (("h", np.uint64), ("key", np.int64), ("variant", np.int64), ("often", bool)))
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    twice = often[order]
    twice[1:] |= same
    twice[:-1] |= same
    who = order[twice]
    h, key, variant = h[twice], key[who], variant[who]
    order = np.lexsort((variant, key))
    h, key, variant = h[order], key[order], variant[order]
    at = _changes(key, variant)
    return pa.table([pa.array(key[at[:-1]], pa.int64()), pa.array(variant[at[:-1]], pa.int64()), _cut(h, at)], ["of", "of_variant", "prefixes"])


NAMES = ["group", "salt", "of", "of_variant", "starts", "lengths", "a", "k", "v", "b"]
#: A row is a document's repeats (of, of_variant, starts, lengths, and where asked for the earlier place in k, v, a), or a group's entries: runs of windows with their prefix
#: a, place k, v, starts, lengths and the path b of each window. A salt marks the parts of groups of lengthened prefixes (0: parts that
#: meet), whose runs are single windows with the second lane as a.
SCHEMA = "group int, salt int, of long, of_variant long, starts binary, lengths binary, a binary, k binary, v binary, b binary"


def _windows(n: int, window: int, frequent, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = np.unpackbits(frequent.value).view(bool)
        for batch in batches:
            key, variant = (np.asarray(batch.column(c)) for c in ("key", "variant"))
            lists = batch.column("prefixes")
            for lo, hi, data, offsets in spans(batch):
                words = Words(data, offsets)
                s = Suffixes(words, window)
                known = np.unique(np.frombuffer(b"".join(b for row in lists[lo:hi].to_pylist() for b in row), dtype=np.uint64))
                place = np.minimum(np.searchsorted(known, s.prefix), max(len(known) - 1, 0))
                often = crowd[slots(s.prefix, COUNTERS)]
                own = known[place] == s.prefix if len(known) else np.zeros(len(often), bool)
                for lengthened in (False, True):
                    who = np.flatnonzero(often if lengthened else own & ~often)
                    if not len(who):
                        continue
                    b = s.paths(words.hash, who, window)
                    a = s.paths(span_hashes(data, words.begin, words.end, 1), who, window) if lengthened else s.prefix[who]
                    doc = s.row[s.start[who]]
                    start = (s.start[who] - words.offsets[doc]).astype(np.int32)
                    yield from _settled(a, b, key[lo + doc], variant[lo + doc], start, n, lengthened, places)

    return run


def _later(a, b, k, v, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows, the later ones of each node, each one's first, and the firsts."""
    order = np.lexsort((start, v, k, b, a))
    at = _changes(a[order], b[order])
    lead = np.repeat(order[at[:-1]], np.diff(at))
    later = (k[order] != k[lead]) | (v[order] != v[lead]) | (start[order] != start[lead])
    return order[later], lead[later], order[at[:-1]]


def _runs(*key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bounds of runs of rows with equal keys whose starts follow each other."""
    return _changes(*key, start - np.arange(len(start)))


def _settled(a, b, k, v, start, n: int, lengthened: bool, places: bool, salted: bool = True) -> Iterator[pa.RecordBatch]:
    """The repeats among these windows by document, and the firsts of nodes as entries of groups."""
    later, lead, first = _later(a, b, k, v, start)
    none = lambda m, t=None: pa.nulls(m, t or pa.binary())
    yield _repeats(k, v, start, later, lead, n, places)
    first = np.sort(first)
    a, b, k, v, start = (x[first] for x in (a, b, k, v, start))
    runs = np.arange(len(a) + 1) if lengthened else _runs(a, k, v, start=start)
    size = np.diff(runs)
    group = _group_of(a[runs[:-1]], n)
    salt = (mix((k ^ v)[runs[:-1]].view(np.uint64)) % np.uint64(SALTS)).astype(np.int64) + 1 if lengthened and salted else np.zeros(len(group), np.int64)
    order = np.lexsort((salt, group))
    group, salt, size, begin = group[order], salt[order], size[order], runs[:-1][order]
    at = _changes(group, salt)
    each = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    cells = [_cut(x[begin], at) for x in (a, k, v)]
    salt = pa.array(salt[at[:-1]], pa.int32()) if lengthened else pa.nulls(len(at) - 1, pa.int32())
    ends = np.concatenate([[0], np.cumsum(size)])
    yield pa.RecordBatch.from_arrays([pa.array(group[at[:-1]], pa.int32()), salt, none(len(at) - 1, pa.int64()), none(len(at) - 1, pa.int64()), _cut(start[begin], at), _cut(size.astype(np.int16), at), *cells, _cut(b[each], ends[at])], NAMES)


def _repeats(k, v, start, later, lead, n: int, places: bool) -> pa.RecordBatch:
    """The later windows as runs of starts of each document; with ``places`` also where each run stands earlier."""
    order = np.lexsort((start[later], v[later], k[later]))
    later, lead = later[order], lead[order]
    once = _changes(k[later], v[later], start[later])[:-1]
    later, lead = later[once], lead[once]
    before = (k[lead], v[lead], start[lead].astype(np.int64)) if places else ()
    k, v, start = k[later], v[later], start[later]
    runs = _runs(k, v, *(before[:2] and (*before[:2], before[2] - start)), start=start)
    long = np.flatnonzero(np.diff(runs) > 32767)  # lengths are kept in 16 bits
    if len(long):
        runs = np.unique(np.concatenate([runs, *[np.arange(runs[i], runs[i + 1], 32767) for i in long.tolist()]]))
    size, begin = np.diff(runs), runs[:-1]
    k, v, start = k[begin], v[begin], start[begin]
    at = _changes(k, v)
    m = len(at) - 1
    cells = [_cut(x[begin], at) for x in (before[2].astype(np.uint64), *before[:2])] if places else [pa.nulls(m, pa.binary())] * 3
    k, v = k[at[:-1]], v[at[:-1]]
    group = _group_of(mix((k ^ v).view(np.uint64)), n)
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.nulls(m, pa.int32()), pa.array(k, pa.int64()), pa.array(v, pa.int64()), _cut(start, at), _cut(size.astype(np.int16), at), *cells, pa.nulls(m, pa.binary())], NAMES)


def _entries(table: pa.Table) -> tuple[np.ndarray, ...]:
    a, k, v, start, size, b = (_joined(table.column(c), t) for c, t in (("a", np.uint64), ("k", np.int64), ("v", np.int64), ("starts", np.int32), ("lengths", np.int16), ("b", np.uint64)))
    size = size.astype(np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(a, size), b, np.repeat(k, size), np.repeat(v, size), (np.repeat(start, size) + within).astype(np.int32)


def _gathered(table: pa.Table, places: bool) -> pa.Table:
    """Rows of repeats with one row for each document."""
    of, variant = (table.column(c).to_numpy() for c in ("of", "of_variant"))
    kinds = {"starts": np.int32, "lengths": np.int16} | ({"a": np.uint64, "k": np.int64, "v": np.int64} if places else {})
    size = np.array([len(x) // 4 for x in table.column("starts").to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(len(of)), size)
    order = np.lexsort((variant[row], of[row]))
    row = row[order]
    at = _changes(of[row], variant[row])
    one = row[at[:-1]]
    cells = {c: _cut(_joined(table.column(c), t)[order], at) for c, t in kinds.items()}
    m = len(one)
    cells |= {"group": table.column("group").take(pa.array(one)), "of": pa.array(of[one], pa.int64()), "of_variant": pa.array(variant[one], pa.int64()), "salt": pa.nulls(m, pa.int32())}
    return pa.table([cells.get(c, pa.nulls(m, pa.binary())) for c in NAMES], NAMES)


def _nodes(n: int, places: bool):
    """The repeats of a group's subtrees, beside those that were found before; a part of a group of lengthened prefixes
    also gives its firsts, which still have to meet those of the other parts."""

    def run(table: pa.Table) -> pa.Table:
        entry = pa.compute.is_valid(table.column("b"))
        if not pa.compute.any(entry).as_py():
            return _gathered(table, places)
        found = _entries(table.filter(entry))
        if (pa.compute.max(table.column("salt")).as_py() or 0) > 0:
            rows = list(_settled(*found, n, True, places, salted=False))
        else:
            later, lead, _ = _later(*found)
            rows = [_repeats(*found[2:], later, lead, n, places)]
        return pa.concat_tables([table.filter(pa.compute.invert(entry)), pa.Table.from_batches(rows)])

    return run


def _kept(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column("repeats"), batch.column("sizes")
            n_words, n_removed, out = [], [], []
            for lo, hi, data, offsets in spans(batch):
                words = Words(data, offsets)
                change = np.zeros(len(words) + 1, dtype=np.int32)
                for r, (row, size) in enumerate(zip(lists[lo:hi].to_pylist(), sizes[lo:hi].to_pylist(), strict=True)):
                    if row:
                        at = _joined(pa.chunked_array([row], pa.binary()), np.int32) + words.offsets[r]
                        np.add.at(change, at, 1)
                        np.add.at(change, at + _joined(pa.chunked_array([size], pa.binary()), np.int16) + (window - 1), -1)
                kept = change[:-1].cumsum() == 0
                total = words.counts()
                begin, end = words.begin[kept], words.end[kept]
                edge = np.concatenate([[0], np.cumsum(kept)])[words.offsets]
                size = end - begin + 1
                place = np.concatenate([[0], np.cumsum(size)])
                text = data[np.minimum(np.repeat(begin - place[:-1], size) + np.arange(place[-1]), max(len(data) - 1, 0))]
                text[place[1:] - 1] = 32
                raw, stop = text.tobytes(), place[edge]
                n_words.append(total)
                n_removed.append(total - np.diff(edge))
                if digest:
                    out += [hashlib.sha256(raw[i : max(i, j - 1)]).hexdigest() for i, j in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
                else:
                    same = (total == np.diff(edge)).tolist()
                    out += [None if s else raw[i : max(i, j - 1)].decode() for s, i, j in zip(same, stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
            counts = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (n_words, n_removed)]
            keep = [c for c in batch.schema.names if c not in ("key", "variant", "repeats", "sizes", "of", "of_variant") and (c != "text" or not digest)]
            columns = [batch.column(c) for c in keep]
            if not digest:
                at = keep.index("text")
                columns[at] = pa.compute.coalesce(pa.array(out, pa.string()), columns[at].cast(pa.string()))
            else:
                columns.append(pa.array(out, pa.string()))
            names = keep + (["kept_sha256"] if digest else [])
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*names, "n_words", "n_removed"])

    return run


def _partitioned(docs: DataFrame, window: int, most: int | None, places: bool):
    """The documents with key and variant, the repeats that the subtrees give, and the condition that joins them."""
    spark = docs.sparkSession
    counts = tally(docs.select("text"), _run_prefixes(window), COUNTERS)
    total = int(counts.sum())
    n = max(32 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // GROUP_ROWS)
    crowd = counts > max(MOST_OCCURRENCES if most is None else most, 4 * total // COUNTERS)
    frequent = spark.sparkContext.broadcast(np.packbits(crowd))
    docs = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64("text").alias("variant"))
    prefixes = docs.select("key", "variant", "text").mapInArrow(_prefixes(n, window, frequent), "group int, h binary, key binary, variant binary, often binary")
    found = prefixes.groupBy("group").applyInArrow(_repeated_prefixes, "of long, of_variant long, prefixes binary")
    found = found.groupBy("of", "of_variant").agg(F.collect_list("prefixes").alias("prefixes"))
    here = (F.col("key") == F.col("of")) & (F.col("variant") == F.col("of_variant"))
    windows = docs.join(found.hint("shuffle_merge"), here).select(*docs.columns, "prefixes").mapInArrow(_windows(n, window, frequent, places), SCHEMA)
    nodes = windows.groupBy("group", "salt").applyInArrow(_nodes(n, places), SCHEMA)
    if crowd.any():  # the firsts of parts meet; repeats pass through, so that the plan still reads the texts' one exchange
        nodes = nodes.groupBy("group", "salt").applyInArrow(_nodes(n, places), SCHEMA)
    return docs, nodes.drop("group", "salt", "b"), here


def _marked(docs: DataFrame, window: int, most: int | None = None) -> DataFrame:
    """``docs`` with key, variant and the runs of their repeats' starts; all texts go through one exchange."""
    docs, nodes, here = _partitioned(docs, window, most, False)
    nodes = nodes.groupBy("of", "of_variant").agg(F.collect_list("starts").alias("repeats"), F.collect_list("lengths").alias("sizes"))
    return docs.join(nodes.hint("shuffle_merge"), here, "left")


def digests(docs: DataFrame, window: int = WINDOW, most: int | None = None) -> DataFrame:
    """(doc_id, kept_sha256, n_words, n_removed) per row of ``docs`` (doc_id, text); ``most``: occurrences of a prefix before it is lengthened."""
    marked = _marked(docs.select("doc_id", "text"), window, most)
    return marked.mapInArrow(_kept(window, True), "doc_id long, kept_sha256 string, n_words long, n_removed long")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeats removed from ``text`` (kept words joined by one space; texts without repeats stay as they are)."""
    docs, names = own_names(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = _marked(docs, window).mapInArrow(_kept(window, False), schema)
    return out.select(*docs.columns).toDF(*names)


def _maximal(window: int):
    """One document's runs, neighbours with one displacement joined."""

    def run(table: pa.Table) -> pa.Table:
        start, size, at, key, variant = (_joined(table.column(c), t) for c, t in (("starts", np.int32), ("lengths", np.int16), ("a", np.uint64), ("k", np.int64), ("v", np.int64)))
        start, at = start.astype(np.int64), at.astype(np.int64)
        order = np.lexsort((start, at - start, variant, key))
        start, end, at, key, variant = start[order], (start + size)[order], at[order], key[order], variant[order]
        joins = _changes(key, variant, at - start, np.cumsum(np.append(True, start[1:] != end[:-1])))
        first, last = joins[:-1], joins[1:] - 1
        keys = [pa.array(np.full(len(first), table.column(c)[0].as_py())) for c in ("of", "of_variant")]
        return pa.table([*keys, *(pa.array(x, pa.int64()) for x in (start[first], end[last] - start[first] + window - 1, key[first], variant[first], at[first]))], ["of", "of_variant", "start", "n_words", "earlier", "earlier_variant", "earlier_start"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, most: int | None = None) -> DataFrame:
    """(doc_id, start, n_words, earlier_doc_id, earlier_start, earlier_variant): the maximal repeats of at least ``window``
    words against an earlier occurrence, in word positions; the earlier text's 64-bit hash tells rows with one doc_id apart."""
    _, nodes, _ = _partitioned(docs.select("doc_id", "text"), window, most, True)
    found = nodes.groupBy("of", "of_variant").applyInArrow(_maximal(window), "of long, of_variant long, start long, n_words long, earlier long, earlier_variant long, earlier_start long")
    named = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(named("of").alias("doc_id"), "start", "n_words", named("earlier").alias("earlier_doc_id"), "earlier_start", "earlier_variant")


def digests_sql(table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``digests`` where doc_ids are distinct and not null."""
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM {table}),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS p FROM texts),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW} - 1], ' ') AS path FROM starts),
firsts AS (SELECT path, min(struct_pack(doc_id := doc_id, p := p)) AS place FROM windows GROUP BY path HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM windows JOIN firsts USING (path) WHERE struct_pack(doc_id := doc_id, p := p) <> place),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
marked AS (SELECT doc_id, word, p, coalesce(max(later.p) OVER (PARTITION BY doc_id ORDER BY p) > p - {WINDOW}, false) AS removed FROM words LEFT JOIN later USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)"""
