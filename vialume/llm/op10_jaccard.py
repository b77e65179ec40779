"""N-gram Jaccard join with rare-first prefix filtering.

A document's set holds its distinct ``shingle``-word n-grams (A-Z lower-cased, 64-bit hashes). Two link when
``100 * |A & B| >= percent * |A | B|``.

1. Classes. Documents with equal sets (128-bit digest) are one class; everything below works on classes.
2. Prefixes. n-grams are ordered rare first, by their count over all documents in a table of 2^18 hashed counters (2 MB,
   whatever the corpus), then by hash. Linked sets share one of their first ``n - ceil(percent n) + 1`` n-grams.
3. Candidates. Classes meet at the n-grams of their prefixes. Pairs must pass the length and positional filters, and
   parity sketches, whose distance never exceeds the sets' difference, drop pairs that can't link (the suffix filter). A
   sketch has 1024 bits, or the power of two over half the set's size; a larger one folds. n-grams that surely have at most
   ``BLOCK`` classes (by 2^20 counters of prefix n-grams) go to groups of hash ranges, where those with few classes make
   pairs as rows; the others are counted exactly, and their classes are dealt to blocks before any group is formed.
4. Verification. Components of candidates are brought together, each class's n-grams once a unit, and all pairs in a
   unit are intersected as a matrix product. Units have at most about ``UNIT_CLASSES`` classes and ``UNIT_GRAMS`` n-grams.
5. Blocks (of a frequent n-gram's classes in 3, of a large component's in 4). First each block is compared with itself
   and with the first block's pivots, which links most of a family of near copies. Then only classes outside the largest
   linked part meet the other blocks, and only pairs that aren't linked yet are compared, so that rows and pairs grow with
   the family and not with its square, and none is left out. Units return spanning forests of their links.

Null or wordless texts have empty sets, link with nothing and are their own component. Rows with equal doc_ids are
separate documents; null doc_ids take part, and a component of them alone has a null id. Empty tables give empty
results. Further columns are ignored (kept in ``representatives``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialume.llm.counters import slots, tally
from vialume.llm.frames import in_few_tasks, own_names
from vialume.llm.graph import components
from vialume.llm.store import materialize
from vialume.llm.text import Words, mix, spans

SHINGLE, PERCENT = 3, 90
COUNTERS, PREFIX_COUNTERS = 1 << 18, 1 << 20
PARITY_BITS, GRAMS_A_BIT = 1024, 2
#: Classes at an n-gram up to which all filtered pairs are made.
FEW = 16
#: Classes of a frequent n-gram that are compared at once.
BLOCK = 4096
UNIT_CLASSES, UNIT_GRAMS = 512, 2_000_000
#: One of so many classes of the first block is a pivot.
PIVOT_SHARE = 16
#: Bits of the map of documents whose sets are verified.
ID_BITS = 1 << 24
#: Parts into which the join of a frequent n-gram's postings with its count is dealt.
SALTS = 64
NULL_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of the distinct n-grams of each row, sorted by both, and the first of each row."""
    words = Words(data, offsets, fold=True)
    at, h = words.windows(k)
    row = words.rows()[at]
    counts = words.counts()
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        own = np.full(len(short), m, dtype=np.uint64)
        for j in range(m):
            own *= np.uint64(0x9FB21C651E98DF25)
            own += words.hash[words.offsets[short] + j]
        row, h = np.concatenate([row, short]), np.concatenate([h, mix(own)])
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(len(offsets)))


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _text_grams(k: int):
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in spans(batch):
            yield shingle_sets(data, offsets, k)[1]

    return hashes


def _prefix_grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield np.frombuffer(b"".join(batch.column("prefix").to_pylist()), dtype=np.uint64)


def _described(k: int, percent: int, shared):
    """doc_id, n, set digest, prefix (rare first), parity sketch and the row key if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.minimum(shared.value, (1 << 20) - 1).astype(np.uint64)
        for batch in batches:
            for lo, hi, data, offsets in spans(batch):
                row, h, first = shingle_sets(data, offsets, k)
                n = np.diff(first)
                edges = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                out = [batch.column("doc_id").cast(pa.int64())[lo:hi], pa.array(n, pa.int64()), pa.array([_digest(h[i:j]) for i, j in edges], pa.binary())]
                rank = row.astype(np.uint64) << np.uint64(48) | counts[slots(h, COUNTERS)] << np.uint64(28) | h >> np.uint64(36)
                order = h[np.argsort(rank, kind="stable")]
                size = n - _needed(n, percent) + 1
                bits = sketch_bits(n)
                ends = np.cumsum(bits)
                parity = np.bincount(np.repeat(ends - bits, n) + (h >> np.uint64(12) & np.uint64((1 << 36) - 1)).astype(np.int64) % np.repeat(bits, n), minlength=int(ends[-1])) & 1
                parity = np.packbits(parity.astype(np.uint8)).tobytes()
                out += [pa.array([order[i : i + s].tobytes() if i < j else b"" for (i, j), s in zip(edges, size.tolist(), strict=True)], pa.binary()), pa.array([parity[i:j] if k else b"" for i, j, k in zip(((ends - bits) // 8).tolist(), (ends // 8).tolist(), n.tolist(), strict=True)], pa.binary())]
                if "row_key" in batch.schema.names:
                    out.append(batch.column("row_key")[lo:hi])
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "key", "prefix", "parity", "row_key"][: len(out)])

    return run


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of sets of these sizes: a power of two."""
    most = np.maximum(n / (GRAMS_A_BIT * PARITY_BITS), 1)
    return PARITY_BITS << np.ceil(np.log2(most)).astype(np.int64)


def sketch_distances(sketches: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of each pair differ, the larger one folded to the smaller."""
    size, out = np.array([len(v) for v in sketches], dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    least = np.minimum(size[x], size[y]) if len(x) else out
    for width in np.unique(least).tolist():
        pairs = np.flatnonzero(least == width)
        rows = np.unique(np.concatenate([x[pairs], y[pairs]]))
        folded = np.empty((len(rows), width), dtype=np.uint8)
        for s in np.unique(size[rows]).tolist():
            own = np.flatnonzero(size[rows] == s)
            raw = np.frombuffer(b"".join([sketches[i] for i in rows[own].tolist()]), dtype=np.uint8)
            folded[own] = np.bitwise_xor.reduce(raw.reshape(len(own), s // width, width), axis=1)
        folded, a, b = folded.view(np.uint64), np.searchsorted(rows, x[pairs]), np.searchsorted(rows, y[pairs])
        for k in range(width // 8):
            out[pairs] += np.bitwise_count(folded[a, k] ^ folded[b, k])
    return out


def _postings(groups: int, shared, frequent: bool):
    """The prefix n-grams of classes: those that surely have at most ``BLOCK`` classes by group, or the others as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            no, n = np.asarray(batch.column("no")), np.asarray(batch.column("n"))
            prefixes = batch.column("prefix").to_pylist()
            size = np.array([len(p) // 8 for p in prefixes], dtype=np.int64)
            gram = np.frombuffer(b"".join(prefixes), dtype=np.uint64)
            who = np.repeat(np.arange(len(no)), size)
            pos = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
            some = np.flatnonzero((counts[slots(gram, PREFIX_COUNTERS)] > BLOCK) == frequent)
            gram, who, pos = gram[some], who[some], pos[some]
            if frequent:
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(no[who]), pa.array(n[who], pa.int32()), pa.array(pos, pa.int32())], ["gram", "no", "n", "pos"])
                continue
            group = ((gram >> np.uint64(33)) * np.uint64(groups) >> np.uint64(31)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            some = np.flatnonzero(np.diff(cuts))
            blobs = []
            for a in (gram, no[who], n[who].astype(np.int32), pos.astype(np.int32)):
                raw, w = a[order].tobytes(), a.dtype.itemsize
                blobs.append(pa.array([raw[i * w : j * w] for i, j in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *blobs], ["group", "gram", "no", "n", "pos"])

    return run


def _candidates(percent: int, few: int):
    def run(table: pa.Table) -> pa.Table:
        gram, no, n, pos = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=k) for c, k in (("gram", np.uint64), ("no", np.int64), ("n", np.int32), ("pos", np.int32)))
        order = np.lexsort((no, n, gram))
        gram, no, n, pos = gram[order], no[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        edge = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(gram)))
        a, b = [], []
        for s in range(2, few + 1):
            at = edge[size == s]
            if len(at):
                i, j = np.triu_indices(s, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = _may_link(n[x], n[y], pos[x], pos[y], percent)
                a.append(no[x[ok]])
                b.append(no[y[ok]])
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        many = np.flatnonzero(np.repeat(size > few, size))
        none = lambda k, t=pa.int64(): pa.nulls(k, t)
        pairs = pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), none(len(a)), none(len(a), pa.int32()), none(len(a), pa.int32())], ["a", "b", "gram", "n", "pos"])
        rest = pa.table([pa.array(no[many], pa.int64()), none(len(many)), pa.array(gram[many].view(np.int64), pa.int64()), pa.array(n[many], pa.int32()), pa.array(pos[many], pa.int32())], ["a", "b", "gram", "n", "pos"])
        return pa.concat_tables([pairs, rest])

    return run


def _may_link(n_x, n_y, pos_x, pos_y, percent: int):
    """The length filter and the positional filter for sets that share the n-grams at these positions."""
    needed = -(-percent * (n_x + n_y) // (100 + percent))
    return (np.minimum(n_x, n_y) * 100 >= percent * np.maximum(n_x, n_y)) & (np.minimum(pos_x, pos_y) + np.minimum(n_x - pos_x, n_y - pos_y) >= needed)


def _frequent(percent: int):
    """Spanning forests of the pairs that pass the filters, among the classes of each frequent n-gram in the table."""

    def run(table: pa.Table) -> pa.Table:
        gram, no, n, pos, side, label = (table.column(c).to_numpy().astype(np.int64) for c in ("of", "no", "n", "pos", "side", "label"))
        across = len(side) > 0 and side[0] >= 0
        parity = table.column("parity").to_pylist()
        order = np.lexsort((no, n, gram))
        a, b = [], []
        for who in np.split(order, np.flatnonzero(np.diff(gram[order])) + 1):
            m, root = len(who), np.arange(len(who))
            step = max(1, 4_000_000 // max(m, 1) // 16)
            for i in range(0, m, step):
                x = who[i : i + step]
                stop = int(np.searchsorted(n[who] * percent, n[x[-1]] * 100, side="right"))
                y = who[i:stop]
                ok = _may_link(n[x][:, None], n[y][None, :], pos[x][:, None], pos[y][None, :], percent)
                if across:
                    ok &= (side[x][:, None] != side[y][None, :]) & (label[x][:, None] != label[y][None, :])
                ok &= (np.arange(len(x))[:, None] < np.arange(len(y))[None, :]) & (no[x][:, None] != no[y][None, :])
                r, c = np.nonzero(ok)
                total = n[x[r]] + n[y[c]]
                apart = sketch_distances(parity, x[r], y[c])
                near = apart <= total - 2 * -(-percent * total // (100 + percent))
                root = joined(root, i + r[near], i + c[near])
            away = np.flatnonzero(root != np.arange(m))
            a.append(no[who[away]])
            b.append(no[who[root[away]]])
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table([flat(a), flat(b)], ["a", "b"])

    return run


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-index roots after joining the edges (a, b)."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _sketch_filter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.arange(batch.num_rows)
            apart = sketch_distances([*batch.column("parity_a").to_pylist(), *batch.column("parity_b").to_pylist()], first, first + batch.num_rows)
            n = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            most = n - 2 * -(-percent * n // (100 + percent))
            ok = pa.array(apart <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nos, units = (batch.column(c).to_pylist() for c in ("key", "no", "units"))
            for lo, hi, data, offsets in spans(batch):
                _, h, first = shingle_sets(data, offsets, k)
                out = []
                for r in range(lo, hi):
                    own = h[first[r - lo] : first[r - lo + 1]]
                    if _digest(own) == keys[r]:
                        out += [(*(u[c] for c in UNIT), nos[r], own.tobytes()) for u in units[r]]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [*UNIT, "no", "grams"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices."""
    m = len(sets)
    out = np.zeros((m, m), dtype=np.float32)
    _, gram, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = np.cumsum(seen > 1) - 1
    ok = seen[gram] > 1
    gram, who = shared[gram[ok]], who[ok]
    order = np.argsort(gram, kind="stable")
    gram, who = gram[order], who[order]
    width = 4096
    for lo in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        i, j = np.searchsorted(gram, [lo, lo + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[who[i:j], gram[i:j] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def spanning(link: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric link matrix reaches."""
    m = len(link)
    root = np.arange(m)
    while True:
        new = np.minimum(root, np.where(link, root[None, :], m).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(percent: int):
    def run(table: pa.Table) -> pa.Table:
        comp, no, side, label = (table.column(c).to_numpy() for c in ("of", "no", "side", "label"))
        across = len(side) > 0 and side[0] >= 0
        sets = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
        order = np.lexsort((side, no, comp))
        same = (no[order][1:] == no[order][:-1]) & (side[order][1:] == side[order][:-1])
        order = order[np.append(True, ~same)] if len(order) else order
        a, b = [], []
        for who in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(who) < 2:
                continue
            both = intersections([sets[i] for i in who])
            n = np.array([len(sets[i]) for i in who])
            link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
            if across:
                link &= (side[who][:, None] != side[who][None, :]) & (label[who][:, None] != label[who][None, :])
            root = spanning(link)
            away = np.flatnonzero(root != np.arange(len(who)))
            a.append(no[who[away]])
            b.append(no[who[root[away]]])
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table([flat(a), flat(b)], ["a", "b"])

    return run


def _chosen(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be among ``picks``: by a bitmap of 2^24 hashed ids (2 MB, whatever the input),
    so that few texts but the needed ones are shuffled. A full bitmap only lets more rows through."""
    spark, slot = docs.sparkSession, lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS)).cast("int").alias("slot")
    bits = np.zeros(ID_BITS, dtype=bool)
    bits[picks.select(slot("pick")).distinct().toArrow().column("slot").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("slot"))
            yield batch.select(["doc_id", "text"]).filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return docs.select("doc_id", "text", slot("doc_id")).mapInArrow(run, "doc_id long, text string")


#: A unit of comparison (bucket, lo, hi); the n-gram or component compared in it; in later units the side and the label so far.
UNIT = ("bucket", "lo", "hi", "side", "of", "label")


def _blocked(members: DataFrame, compare, groups: int, size: int, name: str) -> DataFrame:
    """Forests (a, b) of the linked pairs among the members (of, no, blocks, ...) of each ``of``; ``compare`` maps units to links."""
    one = F.lit(1).cast("int")
    unit = lambda bucket, lo, hi, side, label: [bucket.cast("long").alias("bucket"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), side.cast("int").alias("side"), label.cast("long").alias("label")]
    single = members.filter("blocks = 1").select("*", *unit(F.pmod(F.xxhash64("of"), F.lit(groups)), -one, -one, -one, F.lit(0)))
    many = members.filter("blocks > 1")
    if many.isEmpty():
        return compare(single)
    many = many.withColumn("own", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    own = many.select("*", *unit(F.col("of"), F.col("own"), one * 0, -one, F.lit(0)))
    pivots = many.filter((F.col("own") == 0) & (F.pmod(F.xxhash64("no", F.lit(1)), F.lit(max(1, min(PIVOT_SHARE, size)))) == 0)).withColumn("block", F.explode(F.sequence(one, F.col("blocks") - 1)))
    pivots = pivots.select("*", *unit(F.col("of"), F.col("block"), one * 0, -one, F.lit(0))).drop("block")
    first = materialize(compare(single.unionByName(own.drop("own")).unionByName(pivots.drop("own"))), f"{name}-first")

    roots = components(first, name).select(F.col("node").alias("of_no"), "root")
    many = materialize(many.join(roots, F.col("no") == F.col("of_no"), "left").withColumn("label", F.coalesce("root", "no")).drop("of_no", "root").transform(in_few_tasks), f"{name}-labelled")
    parts = many.groupBy("of", "blocks", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("of", "blocks")
    parts = parts.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / size).cast("int").alias("rests")).filter("rests > 0")
    parts = parts.withColumn("in_own", F.explode(F.sequence(one * 0, F.col("blocks") - 1))).select(F.col("of").alias("in_of"), "in_own", "main", "rests")
    many = many.join(parts, (F.col("of") == F.col("in_of")) & (F.col("own") == F.col("in_own"))).drop("in_of", "in_own")
    base = many.withColumn("rest", F.explode(F.sequence(one * 0, F.col("rests") - 1)))
    base = base.select(*members.columns, *unit(F.col("of"), F.col("own"), F.col("rest"), one * 0, F.col("label")))
    rest = many.filter("label <> main").withColumn("block", F.explode(F.sequence(one * 0, F.col("blocks") - 1)))
    rest = rest.select(*members.columns, *unit(F.col("of"), F.col("block"), F.pmod(F.xxhash64("no", F.lit(2)), F.col("rests")), one, F.col("label")))
    return first.union(compare(base.unionByName(rest)))


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, few: int = FEW) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text)."""
    return _linked(docs, shingle, percent, few).select("doc_id", "n_shingles", "component_id")


def _row_key(docs: DataFrame):
    """A key that only rows which are equal in every column share."""
    text = F.coalesce("text", F.lit(""))
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    return F.md5(F.concat(others, F.lit("\n"), F.col("text").isNull().cast("string"), text))


def _linked(docs: DataFrame, shingle: int, percent: int, few: int = FEW, keyed: bool = False) -> DataFrame:
    """The rows of ``linked`` with the component's number (none for wordless rows) and, if ``keyed``, each row's key."""
    spark = docs.sparkSession
    own = [_row_key(docs).alias("row_key")] if keyed else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own)
    groups = 32 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(tally(docs.select("text"), _text_grams(shingle), COUNTERS))
    schema = "doc_id long, n long, key binary, prefix binary, parity binary" + (", row_key string" if keyed else "")
    rows = materialize(docs.mapInArrow(_described(shingle, percent, shared), schema), "jaccard-rows")
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("label"), F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("pick"), *[F.any_value(c).alias(c) for c in ("n", "prefix", "parity")])
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "jaccard-classes")

    prefixes = classes.select("no", "n", "prefix")
    crowd = spark.sparkContext.broadcast(tally(prefixes.select("prefix"), _prefix_grams, PREFIX_COUNTERS))
    postings = prefixes.mapInArrow(_postings(groups, crowd, False), "group int, gram binary, no binary, n binary, pos binary")
    met = materialize(postings.groupBy("group").applyInArrow(_candidates(percent, few), "a long, b long, gram long, n int, pos int"), "jaccard-met")
    side = lambda s: classes.select(F.col("no").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}"))
    pairs = in_few_tasks(in_few_tasks(met.filter("b IS NOT NULL").select("a", "b").distinct()).join(side("a"), "a")).join(side("b"), "b")
    pairs = in_few_tasks(pairs).mapInArrow(_sketch_filter(percent), "a long, b long")

    crowded = prefixes.mapInArrow(_postings(groups, crowd, True), "gram long, no long, n int, pos int")
    counts = crowded.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("gram").alias("in_gram"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    crowded = crowded.join(counts, (F.col("gram") == F.col("in_gram")) & (F.pmod(F.xxhash64("no"), F.lit(SALTS)) == F.col("salt"))).select("gram", "no", "n", "pos", "blocks")
    often = met.filter("b IS NULL").select("gram", F.col("a").alias("no"), "n", "pos", F.lit(1).alias("blocks")).unionByName(crowded)
    often = materialize(in_few_tasks(often.withColumnRenamed("gram", "of")), "jaccard-often")
    sketches = classes.select(F.col("no").alias("of_no"), "parity")
    sketched = lambda units: units.join(sketches, F.col("no") == F.col("of_no")).drop("of_no").groupBy("bucket", "lo", "hi").applyInArrow(_frequent(percent), "a long, b long")
    pairs = pairs.union(_blocked(often, sketched, groups, BLOCK, "jaccard-often"))
    near = components(pairs, "jaccard-near").withColumnRenamed("root", "comp")

    nodes = near.join(classes.select("no", "key", "pick", "n"), F.col("node") == F.col("no"))
    sizes = nodes.groupBy(F.col("comp").alias("in_comp")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / UNIT_CLASSES, F.sum("n") / UNIT_GRAMS)).cast("int").alias("blocks"))
    nodes = materialize(in_few_tasks(nodes.join(sizes, F.col("comp") == F.col("in_comp")).select(F.col("comp").alias("of"), "no", "key", "pick", "blocks")), "jaccard-nodes")

    def verified(units: DataFrame) -> DataFrame:
        per = units.groupBy("no", "key", "pick").agg(F.collect_list(F.struct(*UNIT)).alias("units"))
        named = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
        found = in_few_tasks(_chosen(named, per.select("pick")).join(per.hint("shuffle_merge"), F.col("doc_id") == F.col("pick")).select("text", "no", "key", "units"))
        sets = found.mapInArrow(_sets(shingle), "bucket long, lo int, hi int, side int, of long, label long, no long, grams binary")
        return sets.groupBy("bucket", "lo", "hi").applyInArrow(_verified(percent), "a long, b long")

    roots = components(_blocked(nodes, verified, groups, UNIT_CLASSES, "jaccard-large"), "jaccard-links").join(classes.select("no", "label"), F.col("node") == F.col("no"))
    least = roots.groupBy(F.col("root").alias("of")).agg(F.min("label").alias("component_id"))
    changed = roots.join(least, F.col("root") == F.col("of")).select(F.col("no").alias("member"), "component_id", "root")
    named = classes.select("key", "no", "label").join(changed, F.col("no") == F.col("member"), "left")
    named = named.select(F.col("key").alias("of_key"), F.coalesce("component_id", "label").alias("component_id"), F.coalesce("root", "no").alias("component"))
    out = rows.select("doc_id", "n", "key", *(["row_key"] if keyed else [])).join(named, (F.col("key") == F.col("of_key")) & (F.col("n") > 0), "left")
    named = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), named, "component", *(["row_key"] if keyed else []))


def representatives(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), of rows with that doc_id one; all wordless rows.

    Of rows with the same doc_id the one with the smallest digest over all columns stays, so reruns agree.
    """
    docs, names = own_names(docs)
    rows = _linked(docs, shingle, percent, keyed=True).filter("component IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    kept = first.select(F.col("first.row_key").alias("kept_key"))
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    out = docs.filter(worded).withColumn("row_key", _row_key(docs))
    out = out.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").dropDuplicates(["row_key"]).drop("row_key")
    return out.union(docs.filter(~worded)).toDF(*names)


def linked_sql(table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``linked`` where doc_ids are distinct and not null."""
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+'), []) AS w FROM {table}),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {SHINGLE} - 1], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 2, least(len(w), 1) + 1))) AS p FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS same FROM grams GROUP BY doc_id),
classes AS (SELECT same, min(doc_id) AS doc_id, any_value(n) AS n FROM sizes GROUP BY same),
shown AS (SELECT c.doc_id, c.n, gram FROM classes c JOIN grams g ON c.doc_id = g.doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM shown a JOIN shown b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM classes UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
named AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, t.doc_id) AS component_id
FROM texts t LEFT JOIN sizes s ON t.doc_id = s.doc_id LEFT JOIN classes c ON s.same = c.same LEFT JOIN named m ON c.doc_id = m.doc_id"""
