"""The row checks and quality levels on streams."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from attestor import scale
from attestor.functions import quality
from attestor.session import scratch_folder


def stream_quality(events: DataFrame, defect: Column, time: str = "ts", window: str = "1 hour",
                   delay: str = "10 minutes", group: list[str] | None = None) -> DataFrame:
    """DPMO and sigma level of each tumbling window; rows later than ``delay`` are dropped.

    Counts combine before the shuffle, and the state is one row per open window and group.
    """
    keys = [F.window(time, window), *[F.col(c) for c in group or []]]
    counts = (events.withWatermark(time, delay).groupBy(*keys)
              .agg(F.count("*").alias("n_rows"), F.count_if(defect).alias("n_defects")))
    rated = counts.withColumn("dpmo", quality.dpmo(F.col("n_defects"), F.col("n_rows")))
    return rated.select(F.col("window.start").alias("window_start"), *(group or []), "n_rows", "n_defects",
                        "dpmo", quality.sigma(F.col("dpmo")).alias("sigma_level"))


def stream_validate(events: DataFrame, rules: dict[str, Column], parent: DataFrame,
                    on: tuple[str, str], salts: int = 8) -> DataFrame:
    """Each row with the names of the rules it breaks; rows with none are good.

    A rule that gives null is met. The reference ``on`` (column, parent column) is checked by
    a left join with the static parent; it adds the rule name 'reference'. No state is kept.
    Streams are not re-planned at run time, so the join is salted: the rows of a key are
    spread over ``salts`` tasks by their content, and each parent key is repeated as often.
    """
    column, key = on
    parents = (parent.select(F.col(key).alias(column)).distinct()
               .select(column, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
                       F.lit(True).alias("_parent")))
    salt = F.pmod(F.xxhash64(*events.columns), F.lit(salts)).cast("int")
    joined = events.withColumn("_salt", salt).join(parents, [column, "_salt"], "left").drop("_salt")
    broken = scale.rules(
        *[(F.coalesce(~rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()],
        (F.col(column).isNotNull() & F.col("_parent").isNull(), F.lit("reference")))
    return joined.withColumn("broken", broken).drop("_parent")


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("broken") == 0).drop("broken")


def quarantined_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("broken") > 0)


def stream_first(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes",
                 salts: int = 8) -> DataFrame:
    """The first arrival of each key.

    State holds a key only while it is inside the watermark, so a copy that comes more than
    ``delay`` after the first one may pass again; within it the result does not depend on how
    the rows fall into batches. Rows are dealt by their content over ``salts`` tasks that each
    keep the first of a key, so at most that many copies of a busy key meet in one task.
    """
    salt = F.pmod(F.xxhash64(*events.columns), F.lit(salts))
    spread = events.withColumn("_salt", salt).withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, "_salt"])
    return spread.drop("_salt").dropDuplicatesWithinWatermark(keys)


def run_updates(stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Run a stream over what its source holds now; return the last state of each key.

    Windows that the watermark has not closed when the source ends are there too. Each batch
    writes the rows it changes to a folder of its own, again if it is repeated, and the latest
    batch of a key counts.
    """
    path = scratch_folder(stream.sparkSession, purpose)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = (stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")
    rows = spark.read.option("basePath", f"{path}/rows").schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
            .select(*keys, "_last.*").select(*stream.columns))


def run_available(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over what its source holds now, into files; return the written table."""
    path = scratch_folder(stream.sparkSession, purpose)
    query = (stream.writeStream.format("parquet").option("path", f"{path}/rows")
             .option("checkpointLocation", f"{path}/checkpoint").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
