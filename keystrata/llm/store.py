"""Shared scratch space, where operators cut lineage, and a join that splits hot keys.

Everything goes under ``spark.checkpoint.dir``, which driver and executors share, and is removed
when the application ends.  A local folder is used only by a local master without that
setting, as in tests; a cluster without it is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed_at_end, shared_dir, ship

FILE_ROWS = 1 << 20  # rows of a file, at the least, where the number of rows is known to be bounded
HOT = 200  # a key is hot if it has more than this part of all rows, so there are fewer hot keys than this


class Scratch:
    """A folder of its own for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        removed_at_end(spark, self.path)

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and reread: cuts lineage, and survives the loss of any executor.

        rows: a bound of df's rows, where it is known and the rows are small.  Then there are no more files than
        ``FILE_ROWS`` asks for, or one for each core if that is more, instead of one for each shuffle partition.
        """
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables made by ``table`` that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in tables:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if "/" + self.path.rpartition("/")[2] + "/" in folder + "/":
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(conf).delete(path, True)


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, total: int, how: str = "inner", nulls: bool = True) -> DataFrame:
    """rows joined ("inner" or "left") with keyed, which has one row for each key and counts the key's rows in column ``n``.

    Keys with more than a part in HOT of all rows are broadcast (fewer than HOT rows), and rows without a
    key are not dealt; so whatever the shuffle deals to one task has at most that part.  nulls: whether there
    may be such rows; without them rows are read once less.  n is dropped.
    """
    hot = F.col("n") * HOT > total
    few = keyed.where(hot).select(F.col(key).alias("_hot"))
    hits = F.broadcast(few)
    many = rows.join(hits, F.col(key) == hits["_hot"], "left").withColumn("_hot", F.col("_hot").isNotNull())
    by_broadcast = rows.join(F.broadcast(keyed.where(hot).drop("n")), key)
    rest = many.where(~F.col("_hot")).drop("_hot")
    dealt = rest.where(F.col(key).isNotNull()) if nulls else rest
    out = by_broadcast.unionByName(dealt.join(keyed.where(~hot).drop("n"), key, how))
    return out.unionByName(rest.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" and nulls else out
