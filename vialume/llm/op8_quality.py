"""Quality rules: base counts and bands on n-gram perplexity.

Each language has an interpolated modified Kneser-Ney model of order 3 over the bytes of all its texts; languages with
fewer than ``LEAST_CELL`` documents share one. Spark counts the trigrams of every text by language (a text is preceded by
two line feeds) into a table in the shared folder, from which models are built language by language; lower orders are
continuation counts. A model is kept in arrays sorted by hash with binary search; the hash is the packed n-gram, so no two
collide. A language has at most 256^3 trigrams whatever the corpus, and languages are taken together up to
``MODEL_ENTRIES`` trigrams at a time: each such group's arrays are broadcast to the scan of its own documents, so every
text is scored in one scan and what is broadcast stays bounded. On labelled documents, order 3 tells junk apart better than 4 and
5 do, held out or not: of what passes the base rules, at 2 % of good documents lost, 80 % of junk against 64 and 55 %.

A document's value is its mean negative log probability a byte (the log of its perplexity): each ``SEGMENT`` bytes count by
the likelier of the language's model and the one of all texts, so a passage in another language isn't held against a
document. It is summed in whole units of 2^-20, so it doesn't depend on what else is in a batch or partition. For each language, values are counted in bins of
1/500 over all documents; the band reaches from ``REACH`` interquartile ranges below the first to ``REACH_ABOVE`` above
the third quartile (a range counts as ``LEAST_RANGE`` at least), and documents outside are rejected. The band scales with
how much values of short texts scatter: bands are kept for each power of two of text bytes. Where fewer than ``LEAST_CELL``
documents share both, the band is that of the language with the neighbouring powers, then of the language, then of all
documents, so that no few documents set their own.

base_failed: fewer than 20 words, or more than 30 % of words in repeated 8-word windows. Null texts count as empty (base
fails, no value). Null languages are one language; languages whose 20-bit hashes agree share a model, not a band. Rows are
independent but for the models and the bands; repeated rows give repeated results; further columns stay as they are in
``filter_documents`` and are ignored in ``rules``. A text is handled whole. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vialume.llm.counters import tally
from vialume.llm.frames import in_few_tasks, own_names
from vialume.llm.store import discard, materialize
from vialume.llm.text import IS_WORD, Words, mix, spans

LEAST_WORDS, MOST_REPEATED_PCT, REPEAT_WINDOW = 20, 30, 8
#: By the labels of sf0.1: laced texts lie far below, salad a little above; a nearer lower end changes nothing.
REACH, REACH_ABOVE, LEAST_RANGE = 2, 1.75, 0.02
#: Counters of documents by hashed language; trigrams of the models that are broadcast together, beyond the first's own.
LANGUAGES, MODEL_ENTRIES = 1 << 20, 4_000_000
#: Parts into which the rows of a band are dealt.
SALTS = 64
#: Bytes that are judged by one model.
SEGMENT = 64
#: Units in a natural logarithm.
UNITS = 1 << 20
#: Distinct trigrams that a counting task holds before it gives them out.
COUNTED_AT_ONCE = 4_000_000
#: Documents that a band is made of at least, but for the band of all.
LEAST_CELL = 50
BINS = 500
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
VALUES_SCHEMA = "doc_id long, variant long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, value double"


def packed_trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``a << 16 | b << 8 | c`` for each byte c of each row and the two before it."""
    c = data.astype(np.uint32)
    b, a = np.full(len(c), 10, np.uint32), np.full(len(c), 10, np.uint32)
    b[1:], a[2:] = c[:-1], c[:-2]
    first = offsets[:-1][np.diff(offsets) > 0]
    b[first] = a[first] = 10
    second = offsets[:-1][np.diff(offsets) > 1] + 1
    a[second] = 10
    return a << 16 | b << 8 | c


def _model_of(slot: np.ndarray, shared) -> np.ndarray:
    """The model of each language slot: its own, or 0 for rare languages."""
    return np.where(shared.value[slot], slot + 1, 0).astype(np.int64)


def _keys(batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, shared) -> np.ndarray:
    """``model << 24 | trigram`` for each byte of the rows."""
    model = _model_of(np.asarray(batch.column("slot"))[lo:hi], shared)
    return np.repeat(model << 24, np.diff(offsets)) | packed_trigrams(data, offsets).astype(np.int64)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def given() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts]))
            return pa.RecordBatch.from_arrays([pa.array(keys >> 24, pa.int32()), pa.array(keys & 0xFFFFFF, pa.int32()), pa.array(n.astype(np.int64))], ["model", "gram", "n"])

        for batch in batches:
            for lo, hi, data, offsets in spans(batch):
                code, seen = pd.factorize(_keys(batch, lo, hi, data, offsets, shared))
                parts.append((seen, np.bincount(code, minlength=len(seen))))
                held += len(seen)
                if held > COUNTED_AT_ONCE:
                    yield given()
                    parts, held = [], 0
        if parts:
            yield given()

    return run


@dataclass(frozen=True)
class Model:
    """Sorted packed n-grams with log probabilities, and the back-off weights of their contexts."""

    grams: np.ndarray
    log_p: np.ndarray
    pairs: np.ndarray
    pair_p: np.ndarray
    contexts: np.ndarray
    gamma: np.ndarray
    single_p: np.ndarray
    short_gamma: np.ndarray

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.full(len(grams), np.log(1 / 256))
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out = self.log_p[at].astype(np.float64)
        new = np.flatnonzero(self.grams[at] != grams)
        if len(new):
            out[new] = np.log(self._backed_off(grams[new]))
        return out

    def _backed_off(self, grams: np.ndarray) -> np.ndarray:
        find = lambda keys, values, x, none: np.where(keys[k := np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x, values[k], none)
        low = grams & 0xFFFF
        pair = find(self.pairs, self.pair_p, low, self.short_gamma[low >> 8] * self.single_p[low & 255])
        return find(self.contexts, self.gamma, grams >> 8, 1.0) * pair


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts of counts 1, 2 and more, from the numbers of n-grams that occur once to four times."""
    n1, n2, n3, n4 = (float((n == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.0, [0.0, 1.0, 2.0, 3.0])


def _level(context: np.ndarray, n: np.ndarray, size: int):
    """Discounted shares of n-grams in their contexts, and the mass that each context leaves."""
    d = discounts(n)[np.minimum(n, 3)]
    total, left = np.bincount(context, n, size), np.bincount(context, d, size)
    with np.errstate(invalid="ignore", divide="ignore"):
        gamma = np.where(total > 0, left / total, 1.0)
    return (n - d) / total[context], gamma


def kneser_ney(grams: np.ndarray, n: np.ndarray) -> Model:
    """The model of a table of trigram counts, sorted by packed trigram."""
    grams, n = grams.astype(np.uint32), n.astype(np.int64)
    pairs, kinds = np.unique(grams & 0xFFFF, return_counts=True)
    singles = np.bincount(pairs & 255, minlength=256)
    some = np.flatnonzero(singles)
    share, left = _level(np.zeros(len(some), np.int64), singles[some], 1)
    single_p = np.full(256, left[0] / 256 if len(some) else 1 / 256)
    single_p[some] += share
    share, short_gamma = _level(pairs >> 8, kinds, 256)
    pair_p = share + short_gamma[pairs >> 8] * single_p[pairs & 255]
    contexts, context = np.unique(grams >> 8, return_inverse=True)
    share, gamma = _level(context, n, len(contexts))
    low = pair_p[np.searchsorted(pairs, grams & 0xFFFF)] if len(grams) else np.zeros(0)
    return Model(grams, np.log(share + gamma[context] * low).astype(np.float32), pairs, pair_p, contexts, gamma, single_p, short_gamma)


def trigrams(docs: DataFrame, shared) -> DataFrame:
    """(model, gram, n) over all texts of ``docs`` (text, slot)."""
    counts = docs.select("text", "slot").mapInArrow(_count(shared), "model int, gram int, n long")
    return materialize(counts.groupBy("model", "gram").agg(F.sum("n").alias("n")), "quality-trigrams")


def groups(sizes: dict[int, int], most: int = MODEL_ENTRIES) -> list[list[int]]:
    """Models in groups of at most ``most`` trigrams, or of one model."""
    out, held = [[]], 0
    for model, n in sorted(sizes.items()):
        if out[-1] and held + n > most:
            out.append([])
            held = 0
        out[-1].append(model)
        held += n
    return out


def log_units(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (model and trigram) and log probabilities in whole units, from the counts of some models."""
    model, gram, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("model", "gram", "n"))
    order = np.lexsort((gram, model))
    model, gram, n = model[order], gram[order], n[order]
    edge = np.flatnonzero(np.append(True, model[1:] != model[:-1])) if len(model) else np.zeros(0, np.int64)
    units = [np.rint(kneser_ney(g, k).log_p.astype(np.float64) * UNITS).astype(np.int32) for g, k in zip(np.split(gram, edge[1:]), np.split(n, edge[1:]), strict=True)]
    return model << 24 | gram, np.concatenate(units)


def repeat_words(words: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """For each row, the words inside k-word windows that occur twice or more in it."""
    at, h = words.windows(k)
    row = words.rows()
    own = mix(h + row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(own)
    own = own[order]
    same = own[1:] == own[:-1]
    twice = np.zeros(len(own), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(words) + 1, dtype=np.int64)
    start = at[order[twice]]
    np.add.at(change, start, 1)
    np.add.at(change, start + k, -1)
    covered = np.concatenate([[0], np.cumsum(change[:-1].cumsum() > 0)])
    return np.diff(covered[words.offsets])


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def best_sums(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, the sum over its segments of the larger sum of ``a`` or ``b`` in the segment."""
    n = -(-np.diff(offsets) // SEGMENT)
    ends = np.concatenate([[0], np.cumsum(n)])
    if not len(a):
        return np.zeros(len(n), dtype=np.int64)
    starts = np.repeat(offsets[:-1], n) + SEGMENT * (np.arange(ends[-1]) - np.repeat(ends[:-1], n))
    best = np.maximum(np.add.reduceat(a.astype(np.int64), starts), np.add.reduceat(b.astype(np.int64), starts))
    return np.diff(np.concatenate([[0], np.cumsum(best)])[ends])


def _values(shared, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, units, common, common_units = table.value
        for batch in batches:
            for lo, hi, data, offsets in spans(batch):
                words = Words(data, offsets)
                n = np.diff(offsets)
                per_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])  # noqa: B023, E731
                code, seen = pd.factorize(_keys(batch, lo, hi, data, offsets, shared))
                here = units[np.searchsorted(known, seen)], common_units[np.searchsorted(common, seen & 0xFFFFFF)]
                total = best_sums(here[0][code], here[1][code], offsets)
                raw = data.tobytes()
                lines = [dup_lines(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                found = [words.counts(), per_row(IS_WORD[data] & ((data & 0xC0) != 0x80)), per_row(_IS_SYMBOL[data]), np.array(lines), repeat_words(words), n]
                keep = [batch.column(c)[lo:hi] for c in ("doc_id", "variant", "lang")]
                value = -total / (np.maximum(n, 1) * float(UNITS))
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, pa.int64()) for x in found), pa.array(value, pa.float64(), mask=n == 0)], [c.split()[0] for c in VALUES_SCHEMA.split(", ")])

    return run


def scored(docs: DataFrame, most: int = MODEL_ENTRIES) -> DataFrame:
    """Base counts and value of each row of ``docs`` (doc_id, variant, lang, text), scored by its language's model."""
    spark = docs.sparkSession
    docs = docs.withColumn("slot", F.pmod(F.xxhash64("lang"), F.lit(LANGUAGES)).cast("int"))
    seen = tally(docs.select("slot"), lambda batch: iter([np.asarray(batch.column("slot")).astype(np.uint64)]), LANGUAGES)
    shared = spark.sparkContext.broadcast(seen >= LEAST_CELL)
    counts = trigrams(docs, shared)
    sizes = counts.groupBy("model").agg(F.count(F.lit(1)).alias("n")).toArrow()
    parts, empty = [], (np.zeros(0, np.int64), np.zeros(0, np.int32))
    pooled = counts.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("model", F.lit(0)).toArrow()
    common = log_units(pooled) if pooled.num_rows else empty
    every = groups(dict(zip(sizes.column("model").to_pylist(), sizes.column("n").to_pylist(), strict=True)), most)
    own = [m - 1 for part in every for m in part if m]
    for part in every:
        mine = [m - 1 for m in part if m]
        rows = docs
        if len(every) > 1:
            rare = ~F.col("slot").isin(own) if 0 in part else F.lit(False)
            rows = docs.filter(F.col("slot").isin(mine) | rare)
        table = log_units(counts.filter(F.col("model").isin(part)).toArrow()) if part else empty
        parts.append(rows.mapInArrow(_values(shared, spark.sparkContext.broadcast((*table, *common))), VALUES_SCHEMA))
    if len(every) > 1 and 0 not in sizes.column("model").to_pylist():  # texts of rare languages that are all empty
        parts.append(docs.filter(~F.col("slot").isin(own)).mapInArrow(_values(shared, spark.sparkContext.broadcast((*empty, *empty))), VALUES_SCHEMA))
    values = materialize(reduce(DataFrame.unionAll, parts), "quality-values")
    discard(counts)
    return values


def bands(values: DataFrame, reach: float = REACH, above: float = REACH_ABOVE) -> DataFrame:
    """(of_lang, of_power, low, high): for each language and power of two of bytes, from counts of value bins."""
    bins = values.filter("value IS NOT NULL").groupBy("lang", _power().alias("power"), F.floor(F.col("value") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = materialize(in_few_tasks(bins), "quality-bins")
    near = bins.withColumn("power", F.explode(F.array(*[F.col("power") + k for k in (-1, 0, 1)])))
    found = _quartiles(bins, "0", "lang", "power").join(_quartiles(near, "1", "lang", "power"), F.col("lang_0").eqNullSafe(F.col("lang_1")) & (F.col("power_0") == F.col("power_1")))
    found = found.join(_quartiles(bins, "2", "lang"), F.col("lang_0").eqNullSafe(F.col("lang_2"))).crossJoin(F.broadcast(_quartiles(bins, "3")))
    pick = F.coalesce(*[F.when(F.col(f"band_{k}.n") >= LEAST_CELL, F.col(f"band_{k}")) for k in range(3)], F.col("band_3"))
    found = found.select(F.col("lang_0").alias("of_lang"), F.col("power_0").alias("of_power"), pick.alias("band")).select("of_lang", "of_power", "band.q1", "band.q3")
    span = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_RANGE))
    return found.select("of_lang", "of_power", (F.col("q1") - span * reach).alias("low"), (F.col("q3") + F.lit(1.0 / BINS) + span * above).alias("high"))


def _quartiles(bins: DataFrame, tag: str, *keys: str) -> DataFrame:
    """The keys and a struct of count and quartiles, named by ``tag``, for each value of ``keys``."""
    bins = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    bins = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / F.lit(float(BINS))
    found = bins.groupBy(*keys).agg(F.struct(F.sum("n").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3")).alias(f"band_{tag}"))
    return found.select(*[F.col(c).alias(f"{c}_{tag}") for c in keys], f"band_{tag}")


def _power():
    return F.floor(F.log2(F.greatest(F.col("n_bytes"), F.lit(1)))).cast("int")


def _judged(docs: DataFrame, reach: float) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("variant"), lang.alias("lang"), "text")
    values = scored(docs)
    salt = F.pmod("variant", F.lit(SALTS)).cast("int")  # a language and length may hold a third of all rows
    band = bands(values, reach).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.col("lang").eqNullSafe(F.col("of_lang")) & (_power() == F.col("of_power")) & (salt == F.col("salt"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PCT)
    out = values.join(band, own, "left").drop("salt").withColumn("base_failed", failed)
    inside = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def rules(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity) per row."""
    return _judged(docs, reach).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("value").alias("log_perplexity"))


def filter_documents(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    docs, names = own_names(docs)
    kept = _judged(docs, reach).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("variant").alias("kept_variant")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_variant")), "left_semi").toDF(*names)
