"""Questions answered beside each other by tasks that each need whole tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """The same rows in tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _packed(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """(name, payload, kept columns): batches of rows as compressed Arrow bytes; batches with a kept column hold one value of it."""
    data = [c for c in df.columns if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            for key in [r for r in table.select(keep).group_by(list(keep)).aggregate([]).to_pylist()] if keep else [{}]:
                rows = table
                for k, v in key.items():
                    rows = rows.filter(pa.compute.equal(rows[k], v))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.select(data).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.select(data).combine_chunks())
                yield pa.RecordBatch.from_pydict({"name": [name], "payload": [sink.getvalue().to_pybytes()]} | {k: pa.array([v], table.schema.field(k).type) for k, v in key.items()})

    kept = "".join(f", {k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.mapInArrow(run, f"name string, payload binary{kept}")


class Batches:
    """A table as packed batches, read anew by each loop over it."""

    def __init__(self, payloads: list[pa.Buffer]):
        self.payloads = payloads

    def __iter__(self) -> Iterator[pa.Table]:
        for payload in self.payloads:
            yield pa.ipc.open_stream(payload).read_all()

    def clear(self) -> None:
        self.payloads.clear()
        pa.default_memory_pool().release_unused()


def for_each_block(asked: DataFrame, by: str, whole: dict[str, DataFrame], run: Callable[..., Iterator[pd.DataFrame]], schema: str, own: dict[str, DataFrame] | None = None, least: int = 1, of: tuple[DataFrame, list[str], int] | None = None, packed: tuple[str, ...] = ()) -> DataFrame:
    """What ``run`` (asked, **tables; pandas frames) yields for each block of the rows of ``asked``.

    Rows with equal ``by`` share a block, and there are as many blocks as tasks run at once (``least`` at least) or values of
    ``by``. A block's task gets all rows of the tables ``whole``, and of the tables ``own`` those whose column ``by`` the block
    holds. Tables reach the tasks by a shuffle of packed rows and never pass the driver; callers bound their rows. ``of`` sets
    the blocks: a frame of the block of each value of some columns of ``asked``, ``by`` among them; these columns; how many. Tables named in
    ``packed`` come as ``Batches`` instead of frames.
    """
    spark = asked.sparkSession
    if of is None:
        keys = asked.select(by).distinct()
        blocks = min(keys.count(), max(spark.sparkContext.defaultParallelism, least))
        of = keys.select(by, ((F.row_number().over(Window.orderBy(by)) - 1) % max(1, blocks)).alias("block")), [by], blocks  # questions are few
    of, columns, blocks = of
    if not blocks:
        return spark.createDataFrame([], schema)
    parts = [_packed(asked.join(of, columns), "asked", "block")]
    parts += [_packed(df.join(F.broadcast(of.select(by, "block").distinct()), by), name, "block") for name, df in (own or {}).items()]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    parts += [_packed(df, name).select("name", "payload", every) for name, df in whole.items()]
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)
    empty = {name: to_arrow_schema(df.schema).empty_table() for name, df in [("asked", asked), *whole.items(), *(own or {}).items()]}
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = defaultdict(list)
        for batch in batches:
            for name, payload in zip(batch["name"].to_pylist(), batch["payload"], strict=True):
                found[name].append(payload.as_buffer() if name in packed else pa.ipc.open_stream(payload.as_buffer()).read_all())
        batch = payload = None  # let the last batch go
        if not found["asked"]:
            return
        tables = {name: pa.concat_tables(found.pop(name)) if found[name] else none for name, none in empty.items() if name not in packed}
        for out in run(**{name: Batches(found.pop(name, [])) if name in packed else tables.pop(name).to_pandas() for name in empty}):
            yield pa.RecordBatch.from_pandas(out[names], preserve_index=False)

    return dealt.repartitionById(blocks, "block").mapInArrow(task, schema)
