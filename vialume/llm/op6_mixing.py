"""Mixing sources to target weights along a time-varying curriculum.

Targets. Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
``most_repeats`` times its source's words and the excess is shared again by weight until none is above. In order of
cap / weight the capped sources come first, so one pass of running sums finds them.

Positions. Documents of a source stand in a fixed order (those of over 1/50 of the source or of its target first, large
to small, then by MD5 of doc_id), pass after pass, and a document's copy is taken if it ends before the target. What is
then missing goes, ``FILLS`` times, to the largest document that fits and hasn't been taken in that pass (of a smaller
size each time); its copy comes last. Where more than the source's largest small document is still missing (long documents
that don't fit keep the later ones out), the last pass is planned anew: long documents are taken, large to small, if they
fit in what is left, and the small ones follow in order until one doesn't fit; only taken documents advance the sum. So a
source's taken words stay below its target by a small document at most, or no document is left that fits. While training time runs from 0 to 1, a source is drawn at ``target * (1 + tilt * (2t - 1))`` words a unit of time; the integral of that schedule is inverted at the
copy's cumulative words, which gives its training position, and documents are range-sorted by their first position
(those not taken behind, spread by hash).

Running sums are two-level: a source of n documents has about sqrt(n) hash ranges, whose totals are summed first, so a
source that holds most rows still spreads over many tasks. Null sources are one source; null text has no words; repeated
rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vialume.llm.frames import in_few_tasks, own_names
from vialume.llm.store import materialize

#: A maximal run of other characters than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Slope of the schedule of sources with weight 1, 2, 3: the light ones come early, the heavy ones late.
TILTS = (-0.5, 0.0, 0.5)
FILLS = 3


def targets(sized: DataFrame, most_repeats: int = 3) -> DataFrame:
    """(source, source_size, n_docs, weight, target) of each source; one row each, sorted in one task."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    src = src.withColumn("weight", (rank - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most_repeats)
    before = everything.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    src = src.select("*", F.sum("source_size").over(everything).alias("words"), F.sum("weight").over(everything).alias("weights"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    src = src.withColumn("capped", (wide("words") - wide("caps_before")) * F.col("weight") > wide("cap") * (wide("weights") - wide("weights_before")))
    free = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0))
    src = src.select("*", (F.col("words") - free("cap")).alias("words_left"), (F.col("weights") - free("weight")).alias("weights_left"))
    share = F.col("words_left").cast("double") * F.col("weight").cast("double") / F.col("weights_left").cast("double")
    return src.select("source", "source_size", "n_docs", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def position(tilt: Column, share: Column) -> Column:
    """The time at which a source's schedule has drawn ``share`` of its target: t + tilt (t^2 - t) = share."""
    flat = F.lit(1.0) - tilt
    return F.lit(2.0) * share / (flat + F.sqrt(flat * flat + F.lit(4.0) * tilt * share))


def _replanned(rows: DataFrame, short: DataFrame) -> DataFrame:
    """The last pass of each source that is short of more than a small document: its words and the large ones it takes.

    One row a source; its array holds the source's distinct large sizes while it is folded, and at most 50 after.
    """
    large = F.col("part") < 0
    untaken = (F.col("open") > 0) & (F.col("size") > 0)
    per = rows.groupBy(F.col("source").alias("again_source")).agg(
        F.coalesce(F.sum(F.when(large, F.col("size"))), F.lit(0)).alias("large_words"), F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("small_words"),
        F.max(F.when(~large & (F.col("size") > 0), F.col("size"))).alias("small"), F.min(F.when(untaken, F.col("size"))).alias("least"), (F.first("target") - F.first("source_size") * F.first("passes")).alias("rest"))
    per = per.join(short.select(F.col("source").alias("of"), "short"), F.col("again_source").eqNullSafe(F.col("of"))).drop("of")
    per = per.filter((F.col("least") <= F.col("short")) & F.coalesce(F.col("short") > F.col("small"), F.lit(True)))
    sizes = rows.filter(large).groupBy(F.col("source").alias("of"), "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    per = per.join(sizes, F.col("again_source").eqNullSafe(F.col("of")), "left").drop("of")

    start = "named_struct('base', 0L, 'got', 0L, 'taken', CAST(array() AS array<struct<size: bigint, base: bigint, ahead: bigint, n: bigint>>))"
    n = "least(x.n, CAST(floor((rest - s.got) / x.size) AS BIGINT))"
    step = f"named_struct('base', s.base + x.size * x.n, 'got', s.got + x.size * {n}, 'taken', IF({n} > 0, concat(s.taken, array(named_struct('size', x.size, 'base', s.base, 'ahead', s.got, 'n', {n}))), s.taken))"
    per = per.withColumn("plan", F.expr(f"aggregate(coalesce(sizes, CAST(array() AS array<struct<size: bigint, n: bigint>>)), {start}, (s, x) -> {step})"))
    better = F.least((F.col("plan.got") + F.col("small_words")).cast("double"), F.col("rest")) > F.col("rest") - F.col("short")
    return per.filter(better).select("again_source", "large_words", "rest", F.col("plan.got").alias("large_taken"), F.col("plan.taken").alias("taken_large"))


def mix(docs: DataFrame, most_repeats: int = 3, tilts: tuple[float, float, float] = TILTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, position_ppm) per row of ``docs``, sorted by position."""
    return _planned(docs, most_repeats, tilts)


def _planned(docs: DataFrame, most_repeats: int = 3, tilts: tuple[float, float, float] = TILTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``mix`` with the columns ``keep`` of ``docs`` behind."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    tie = F.xxhash64("text") if keep else F.lit(0).cast("long")  # only kept rows are told apart by it
    sized = materialize(docs.select("doc_id", source.cast("string").alias("source"), words.alias("size"), tie.alias("tie"), *keep), "mix-sizes")
    goals = targets(sized, most_repeats).select(F.col("source").alias("of"), "source_size", "n_docs", "weight", "target")
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ranges = F.ceil(F.sqrt("n_docs"))
    rows = sized.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("place", place)
    rows = rows.withColumn("large", F.col("size") * 50 > F.least(F.col("source_size").cast("double"), F.col("target")))
    spread = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * ranges / F.lit(4294967296.0)).cast("long")
    rows = rows.withColumn("part", F.when(F.col("large"), F.lit(-1).cast("long")).otherwise(spread))

    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("source", "part").orderBy(F.when(F.col("large"), -F.col("size")).otherwise(0), "place", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))

    offset = F.col("ahead") + F.col("within")
    ends = lambda k: (offset + F.col("source_size") * k + F.col("size")).cast("double")
    copies = sum((F.when(ends(k) <= F.col("target"), 1).otherwise(0) for k in range(most_repeats)), F.lit(0)).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(most_repeats).cast("long")
    rows = materialize(rows.select("doc_id", "source", "size", "source_size", "target", "weight", "place", "part", offset.alias("offset"), copies.alias("copies"), passes.alias("passes"), (passes + 1 - copies).alias("open"), *keep), "mix-rows")

    short = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short")).withColumn("below", F.lit(1 << 62))
    sizes = rows.filter((F.col("open") > 0) & (F.col("size") > 0) & (F.col("copies") < most_repeats)).groupBy("source", "size").agg(F.max("offset").alias("offset"))
    picks = None
    for _ in range(FILLS):
        fits = sizes.join(short.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).filter((F.col("size") <= F.col("short")) & (F.col("size") < F.col("below")))
        pick = fits.groupBy("source").agg(F.max(F.struct("size", "offset")).alias("pick"))
        got = pick.select(F.col("source").alias("in_source"), F.col("pick.offset").alias("at"), F.col("pick.size").alias("got"))
        short = short.join(got, F.col("source").eqNullSafe(F.col("in_source")), "left").select("source", (F.col("short") - F.coalesce("got", F.lit(0))).alias("short"), F.coalesce("got", "below").alias("below"))
        picks = got if picks is None else picks.unionByName(got)
    picks = materialize(in_few_tasks(picks), "mix-picks")
    mine = F.col("source").eqNullSafe(F.col("in_source")) & (F.col("offset") == F.col("at")) & (F.col("size") == F.col("got"))
    again = materialize(in_few_tasks(_replanned(rows, short)), "mix-again")
    rows = rows.join(picks, mine, "left").join(again, F.col("source").eqNullSafe(F.col("again_source")), "left")
    rows = rows.withColumn("anew", F.col("taken_large").isNotNull()).withColumn("last", F.col("at").isNotNull() & ~F.col("anew"))

    taken = F.get(F.filter("taken_large", lambda x: x["size"] == F.col("size")), F.lit(0))
    before = F.floor((F.col("offset") - taken["base"]) / F.col("size")).cast("long")
    start = F.when(F.col("part") >= 0, F.col("offset") - F.col("large_words") + F.col("large_taken")).otherwise(taken["ahead"] + before * F.col("size"))
    fits = F.when(F.col("part") >= 0, (start + F.col("size")).cast("double") <= F.col("rest")).otherwise(F.coalesce(before < taken["n"], F.lit(False)))
    rows = rows.withColumn("copies", F.when(F.col("anew"), F.col("passes") + fits.cast("long")).otherwise(F.col("copies")))
    rows = rows.withColumn("offset", F.when(F.col("anew") & (F.col("passes") == 0), start).otherwise(F.col("offset")))

    tilt = F.element_at(F.array(*[F.lit(float(x)) for x in tilts]), F.col("weight"))
    first = F.floor(position(tilt, F.least(F.col("offset").cast("double") / F.col("target"), F.lit(1.0))) * 1000000).cast("long")
    copies = F.col("copies") + F.col("last").cast("long")
    ppm = F.when((F.col("copies") > 0) & (F.col("target") > 0), first).when(copies > 0, F.lit(1000000).cast("long"))
    out = rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), ppm.alias("position_ppm"), *keep, "place")
    behind = F.lit(1000001) + F.conv(F.substring("place", 1, 6), 16, 10).cast("long")
    return out.orderBy(F.coalesce("position_ppm", behind), "place").drop("place")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, sorted by its first position."""
    docs, names = own_names(docs)
    numbered = materialize(docs.withColumn("mix_row", F.monotonically_increasing_id()), "mix-docs")
    plan = _planned(numbered, keep=("mix_row",)).select(F.col("mix_row").alias("of_row"), F.col("copies").alias("mix_copies"), F.col("position_ppm").alias("mix_at")).filter("mix_copies > 0")
    out = numbered.join(plan, F.col("mix_row") == F.col("of_row"))
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return out.orderBy("mix_at", F.xxhash64("doc_id", "mix_row", "mix_copy")).select(*docs.columns).toDF(*names)


def mix_sql(table: str = "documents") -> str:
    """The rows of mix() with its defaults, for DuckDB."""
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
src AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM src),
run AS (SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
  coalesce(sum(cap) OVER b, 0) AS caps_before, coalesce(sum(weight) OVER b, 0) AS weights_before
  FROM ranked WINDOW b AS (ORDER BY cap / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (words - caps_before) * weight > cap * (weights - weights_before) AS is_capped FROM run),
goals AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, weight,
  CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(words - coalesce(sum(cap) FILTER (is_capped) OVER (), 0) AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(weights - coalesce(sum(weight) FILTER (is_capped) OVER (), 0) AS DOUBLE) END AS target
  FROM capped),
placed AS (SELECT s.doc_id, s.size, g.source, g.source_size, g.weight, g.target, md5(coalesce(CAST(s.doc_id AS VARCHAR), '')) AS place,
  s.size * 50 > least(CAST(g.source_size AS DOUBLE), g.target) AS large
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
summed AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN large THEN 0 ELSE 1 END, CASE WHEN large THEN -size ELSE 0 END, place, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, CASE weight WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt FROM placed),
counted AS (SELECT *, least(CAST(off AS DOUBLE) / target, 1.0::DOUBLE) AS share,
  CAST((CASE WHEN CAST(off + size AS DOUBLE) <= target THEN 1 ELSE 0 END) + (CASE WHEN CAST(off + source_size + size AS DOUBLE) <= target THEN 1 ELSE 0 END)
  + (CASE WHEN CAST(off + 2 * source_size + size AS DOUBLE) <= target THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM summed),
short0 AS (SELECT *, target - sum(copies * size) OVER (PARTITION BY source) AS short, false AS taken_last, 4611686018427387904 AS below,
  CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 3 END + 1 - copies AS open FROM counted),
pick0 AS (SELECT source, max(ROW(size, off)) AS pick FROM short0 WHERE open > 0 AND size > 0 AND copies < 3 AND NOT taken_last AND size <= short AND size < below GROUP BY source),
short1 AS (SELECT s.* REPLACE (s.short - coalesce(struct_extract_at(p.pick, 1), 0) AS short, coalesce(struct_extract_at(p.pick, 1), s.below) AS below, s.taken_last OR coalesce(ROW(s.size, s.off) = p.pick, false) AS taken_last)
  FROM short0 s LEFT JOIN pick0 p ON s.source IS NOT DISTINCT FROM p.source),
pick1 AS (SELECT source, max(ROW(size, off)) AS pick FROM short1 WHERE open > 0 AND size > 0 AND copies < 3 AND NOT taken_last AND size <= short AND size < below GROUP BY source),
short2 AS (SELECT s.* REPLACE (s.short - coalesce(struct_extract_at(p.pick, 1), 0) AS short, coalesce(struct_extract_at(p.pick, 1), s.below) AS below, s.taken_last OR coalesce(ROW(s.size, s.off) = p.pick, false) AS taken_last)
  FROM short1 s LEFT JOIN pick1 p ON s.source IS NOT DISTINCT FROM p.source),
pick2 AS (SELECT source, max(ROW(size, off)) AS pick FROM short2 WHERE open > 0 AND size > 0 AND copies < 3 AND NOT taken_last AND size <= short AND size < below GROUP BY source),
short3 AS (SELECT s.* REPLACE (s.short - coalesce(struct_extract_at(p.pick, 1), 0) AS short, coalesce(struct_extract_at(p.pick, 1), s.below) AS below, s.taken_last OR coalesce(ROW(s.size, s.off) = p.pick, false) AS taken_last)
  FROM short2 s LEFT JOIN pick2 p ON s.source IS NOT DISTINCT FROM p.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 3 END AS passes FROM short3),
per AS (SELECT source, any_value(short) AS short, any_value(target - source_size * passes) AS rest, coalesce(sum(size) FILTER (large), 0) AS large_words, coalesce(sum(size) FILTER (NOT large), 0) AS small_words,
  max(size) FILTER (NOT large AND size > 0) AS small, min(size) FILTER (open > 0 AND size > 0) AS least_open FROM passed GROUP BY source),
lacking AS (SELECT * FROM per WHERE least_open <= short AND coalesce(short > small, true)),
bulk AS (SELECT source, size, count(*) AS n, min(off) AS base, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS k FROM passed WHERE large GROUP BY source, size),
fold AS (SELECT source, 0 AS k, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS ahead, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS got, rest FROM lacking
  UNION ALL SELECT f.source, f.k + 1, b.size, b.base, f.got, least(b.n, CAST(floor((f.rest - f.got) / b.size) AS BIGINT)), CAST(f.got + b.size * least(b.n, CAST(floor((f.rest - f.got) / b.size) AS BIGINT)) AS BIGINT), f.rest
  FROM fold f JOIN bulk b ON b.source IS NOT DISTINCT FROM f.source AND b.k = f.k + 1),
planned AS (SELECT l.source, l.rest, l.large_words, f.large_taken FROM lacking l JOIN (SELECT source, max(got) AS large_taken FROM fold GROUP BY source) f ON f.source IS NOT DISTINCT FROM l.source
  WHERE least(CAST(large_taken + small_words AS DOUBLE), l.rest) > l.rest - l.short),
started AS (SELECT p.*, q.rest, q.large_taken IS NOT NULL AS anew, f.n AS n_taken, CASE WHEN p.large THEN f.ahead + CAST(floor((p.off - f.base) / p.size) AS BIGINT) * p.size ELSE p.off - q.large_words + q.large_taken END AS start,
  CASE WHEN p.large THEN CAST(floor((p.off - f.base) / p.size) AS BIGINT) END AS turn
  FROM passed p LEFT JOIN planned q ON q.source IS NOT DISTINCT FROM p.source LEFT JOIN fold f ON f.source IS NOT DISTINCT FROM p.source AND f.size = p.size AND f.k > 0 AND p.large),
final AS (SELECT doc_id, size, source_size, target, tilt, NOT anew AND taken_last AS last,
  CASE WHEN anew THEN passes + CAST(CASE WHEN large THEN coalesce(turn < n_taken, false) ELSE CAST(start + size AS DOUBLE) <= rest END AS BIGINT) ELSE copies END AS copies,
  least(CAST(CASE WHEN anew AND passes = 0 THEN start ELSE off END AS DOUBLE) / target, 1.0::DOUBLE) AS share FROM started)
SELECT doc_id, size, source_size, target, (copies + CAST(last AS BIGINT)) * size AS taken, copies + CAST(last AS BIGINT) AS copies,
  CASE WHEN copies > 0 AND target > 0 THEN CAST(floor(2.0::DOUBLE * share / ((1.0::DOUBLE - tilt) + sqrt((1.0::DOUBLE - tilt) * (1.0::DOUBLE - tilt) + 4.0::DOUBLE * tilt * share)) * 1000000) AS BIGINT)
    WHEN copies + CAST(last AS BIGINT) > 0 THEN 1000000 END AS position_ppm
FROM final"""
