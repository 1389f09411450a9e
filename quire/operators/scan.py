"""Running sums and numbers over ordered rows, by book or over all of them, without a window that holds a book.

Rows are put into range partitions by group and order, summed up within each
partition while they stream by, and written. What a group has in earlier
partitions is then added: of all groups of a partition only its first can have
begun before, so there is one carry a partition, which is broadcast. One group
with all rows and millions of groups of one row both spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row's group differs from the row's before; nulls are a group."""
    out = np.zeros(len(columns[0]) if columns else 0, bool)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _scan(groups: int, sums: int):
    """Streams a sorted partition: appends running sums, which begin anew with each group. The last columns are the values, the first the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carried = None, np.zeros(sums, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch.columns
            first = tuple(c[0].as_py() for c in columns[:groups])
            starts = _starts(columns[:groups]) if groups else np.zeros(batch.num_rows, bool)
            if key is not None and first != key:
                carried[:] = 0
            at = np.maximum.accumulate(np.where(starts, np.arange(batch.num_rows), 0))
            out = []
            for k in range(sums):
                total = np.cumsum(columns[len(columns) - sums + k].to_numpy())
                before = np.where(at > 0, total[at - 1], -carried[k])  # what stands before the row's group, or is still to be added to it
                out.append(pa.array(total - before))
                carried[k] = out[-1][-1].as_py()
            key = tuple(c[-1].as_py() for c in columns[:groups])
            yield pa.RecordBatch.from_arrays([*columns[: len(columns) - sums], *out], names=batch.schema.names)

    return run


def running_sums(rows: DataFrame, group: list[str], order: list[str], partitions: int | None = None, **sums: Column) -> DataFrame:
    """``rows`` with running sums (bigint) of whole numbers, a row's own included, along ``order`` within each ``group``; [] is one group of all rows.

    Null values count as 0, null groups as a group, null orders come first. Rows
    of equal order follow each other in any order. The rows travel and are
    written: give narrow ones, and join the result to wide ones.
    """
    names = [*group, *[c for c in rows.columns if c not in group]]
    zero = F.lit(0).cast("bigint")
    own, held = [f"_v{k}" for k in range(len(sums))], [f"_s{k}" for k in range(len(sums))]
    keys = [F.col(c) for c in (*group, *order)]
    parts = rows.select(*names, *[F.coalesce(v.cast("bigint"), zero).alias(o) for v, o in zip(sums.values(), own)])
    parts = (parts.repartitionByRange(partitions, *keys) if partitions else parts.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    parts = parts.select(*names, F.spark_partition_id().alias("_part"), *own, *[F.col(o).alias(h) for o, h in zip(own, held)])
    scanned = materialize(parts.mapInArrow(_scan(len(group), len(sums)), parts.schema), "scan")
    totals = scanned.groupBy("_part", *group).agg(*[F.sum(o).alias(o) for o in own])
    # of a partition only the first group has anything before: no more rows than partitions
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], *[F.sum(o).over(before).alias(f"_c{k}") for k, o in enumerate(own)]).where("_c0 is not null")
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    joined = scanned.join(F.broadcast(carry), same, "left")
    return joined.select(*names, *[(F.col(h) + F.coalesce(F.col(f"_c{k}"), zero)).alias(s) for k, (s, h) in enumerate(zip(sums, held))])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with their number from 1 along ``order`` within each ``group``. As ``running_sums``."""
    return running_sums(rows, group, order, partitions, **{name: F.lit(1)})
