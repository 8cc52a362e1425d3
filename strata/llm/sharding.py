"""Two-pass external shuffle into shards whose row counts are at most one apart.

Pass one scatters whole records over buckets by a seeded hash of the record;
the number of buckets follows the data's bytes, so that each fits in memory.
Pass two shuffles each bucket by Fisher-Yates from (seed, bucket) and writes
it. A record's global place is its bucket's offset plus its place there; shards
are equal stretches of that order, so a bucket falls into one or two shards.

The order depends on the seed and the records alone, not on how the input is
cut into files, so a lost task is simply run again. Nulls are hashed as values;
repeated rows stay repeated; an empty table gives no rows. Columns of the rows
that are named _bucket, _place, shard or slot are replaced, all others stay.

Rows that agree in the whole key share a hash, so many of them would fill a bucket. Marks
that have more than MOST rows are found first, and their rows, which are written
down for that, are numbered (task by task, then by their places among all tasks'
counts) and scattered by number too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.runtime import chunks_for, fresh, prepare, table

BUCKET_BYTES, MOST = 16 << 20, 10_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n): the swap partners are drawn at once, the swaps are made from the end."""
    partner = np.random.default_rng([seed, bucket]).integers(0, np.arange(1, n + 1)).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = partner[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(rows: DataFrame, key: list[str], size: Column, seed: int, bucket_bytes: int = BUCKET_BYTES, most: int = MOST) -> DataFrame:
    """All columns of rows, and _bucket and _place: each bucket in its shuffled order, written to the shared folder."""
    spark = prepare(rows.sparkSession)
    rows = rows.drop("_bucket", "_place")
    n = chunks_for(rows, size, bucket_bytes)
    mark, number, task, before = fresh(rows, "_mark", "_number", "_task", "_before")
    # xxhash64 leaves nulls out, so a null is hashed as a flag
    own = F.xxhash64(F.lit(seed), *[x for k in key for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))])
    marked = rows.withColumn(mark, own)
    # a mark of more rows than MOST: at most one for MOST rows
    hot = marked.groupBy(mark).count().where(F.col("count") > most).select(mark)
    hot = table(hot, "hot")
    if hot.isEmpty():
        marked = marked.withColumn(number, F.lit(0).cast("long"))
    else:
        some = table(marked.join(hot, mark).withColumn(task, F.spark_partition_id()), "repeated")
        counts = some.groupBy(mark, task).count()
        counts = counts.select(mark, task, (F.sum("count").over(Window.partitionBy(mark).orderBy(task)) - F.col("count")).alias(before))
        numbered = some.withColumn(number, F.row_number().over(Window.partitionBy(mark, task).orderBy(*[F.col(f"`{k}`") for k in key])).cast("long"))
        numbered = numbered.join(counts, [mark, task]).withColumn(number, F.col(number) + F.col(before))
        marked = marked.join(hot, mark, "left_anti").withColumn(number, F.lit(0).cast("long")).unionByName(numbered.drop(task, before))
    cut = marked.withColumn("_bucket", F.pmod(F.xxhash64(mark, number, F.lit(seed + 1)), F.lit(n)))

    def shuffle(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(mark, "ascending"), (number, "ascending"), *[(k, "ascending") for k in key]]))
        order = fisher_yates(len(t), seed, t["_bucket"][0].as_py())
        t = t.take(pa.array(order)).drop_columns([mark, number])
        return t.append_column("_place", pa.array(np.arange(len(t))))

    out = T.StructType([f for f in cut.schema.fields if f.name not in (mark, number)]).add("_place", "long")
    return table(cut.groupBy("_bucket").applyInArrow(shuffle, out), "buckets")


def place(rows: DataFrame, shards: int) -> DataFrame:
    """shard and slot for rows of :func:`shuffled`; the first (rows mod shards) shards hold one row more."""
    rows = rows.drop("shard", "slot")
    count, before, every, at = fresh(rows, "_n", "_before", "_all", "_at")
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias(count))
    # one row for each bucket of BUCKET_BYTES, so this window is small at any size
    w = Window.orderBy("_bucket")
    sizes = sizes.select("_bucket", (F.sum(count).over(w) - F.col(count)).alias(before), F.sum(count).over(Window.partitionBy()).alias(every))
    placed = rows.join(sizes, "_bucket").withColumn(at, F.col(before) + F.col("_place"))
    base, more, here = F.expr(f"{every} div {shards}"), F.col(every) % shards, F.col(at)
    wide = more * (base + 1)
    first = here < wide
    per = F.greatest(base, F.lit(1))
    shard = F.when(first, F.floor(here / (base + 1))).otherwise(more + F.floor((here - wide) / per))
    slot = F.when(first, here % (base + 1)).otherwise((here - wide) % per)
    return placed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop(before, every, at)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").drop("_bucket", "_place").write.partitionBy("shard").parquet(path)
