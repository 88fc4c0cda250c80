"""All pairs of the vectors of a table, by tiles.

Vectors lie in blocks of `BLOCK` rows, blocks in groups of at most `GROUP` bytes, and a tile is a pair of
groups and one task: it holds the blocks of the first and meets those of the second as they come. A
block is sent once for each group, and no task holds more than a tile, however long the table is. The
number of pairs stays the square of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK, GROUP = 512, 16 << 20


def parallelism(spark: SparkSession) -> int:
    """Tasks of a stage whose work is not a matter of its bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def checkpointed(df: DataFrame) -> DataFrame:
    """The computed rows in the folder of spark.checkpoint.dir, which all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set")
            import tempfile

            folder = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


@dataclass
class Block:
    """Vectors of one length, and their keys; -1 for vectors that are null or have a null entry."""

    id: int
    size: int
    keys: pa.Array
    raw: bytes

    @property
    def vectors(self) -> np.ndarray:
        return np.frombuffer(self.raw).reshape(len(self.keys), max(self.size, 0))


def blocks(df: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(id, size, keys, raw): the rows that have a key, in blocks."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("k"), F.when(~F.exists(v, F.isnull), v).alias("v")).filter("k is not null")
    pid = F.shiftleft(F.spark_partition_id().cast("long"), 32)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            keys, listed = b.columns
            sizes = pc.fill_null(pc.list_value_length(listed), -1).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                for first in range(0, len(at), block):
                    mine = pa.array(at[first : first + block])
                    raw = listed.take(mine).flatten().to_numpy(zero_copy_only=False).tobytes() if d > 0 else b""
                    held = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), keys.take(mine))
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([d], pa.int32()), held, pa.array([raw])], ["id", "size", "keys", "raw"])
                    n += 1

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(made, f"id long, size int, keys array<{kind}>, raw binary").withColumn("id", F.col("id") + pid)


def tiled(made: DataFrame, each: Callable[[Iterator[tuple[Block, Block] | None]], Iterator[pa.RecordBatch]], schema: StructType | str, group: int = GROUP) -> DataFrame:
    """The rows that `each` makes of all pairs of (computed) blocks, a block with itself being one; None stands for the end of a tile."""
    total = made.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    groups = max(-(-total // group), math.isqrt(2 * parallelism(made.sparkSession)) + 1)
    g = F.pmod(F.col("id") + F.shiftright("id", 32), F.lit(groups)).cast("int")
    number = lambda i, j: (j * (j + 1) / 2 + i).cast("int")
    first = F.transform(F.sequence(g, F.lit(groups - 1)), lambda j: F.struct(number(g, j).alias("tile"), F.lit(0).alias("side")))
    # 2: meets the blocks of its own group
    second = F.transform(F.sequence(F.lit(0), g), lambda i: F.struct(number(i, g).alias("tile"), F.when(i == g, 2).otherwise(1).alias("side")))
    sent = made.select(F.explode(F.concat(first, second)).alias("t"), "*").select("t.tile", "t.side", *made.columns)
    sent = sent.repartitionById(groups * (groups + 1) // 2, F.col("tile")).sortWithinPartitions("tile", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met() -> Iterator[tuple[Block, Block] | None]:
            held: list[Block] = []
            last = None
            for b in batches:
                for r in range(b.num_rows):
                    tile, side, n, size = (b.column(c)[r].as_py() for c in range(4))
                    y = Block(n, size, b.column(4)[r].values, b.column(5)[r].as_py())
                    if tile != last:
                        if last is not None:
                            yield None
                        held, last = [], tile
                    if side == 0:
                        held.append(y)
                        continue
                    for x in held:
                        if side == 1 or x.id < y.id:
                            yield x, y
                        elif x.id == y.id:
                            yield x, x
            if last is not None:
                yield None

        return each(met())

    return sent.mapInArrow(run, schema)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of all rows of x and y, summed in the order of the entries."""
    out = np.zeros((len(x), len(y)))
    for first in range(0, len(x), 64):  # what is added to stays in the cache
        part = out[first : first + 64]
        for k in range(x.shape[1]):
            part += x[first : first + 64, k, None] * y[None, :, k]
    return out
