"""Input tables and the inputs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: extensions given to documents by their number -------------
EXTENSIONS = (".txt", ".md", ".py", ".sql", ".json", ".csv", ".png", ".pdf", ".mp4", ".docx", ".xyz", ".wav")


def spread(df: DataFrame) -> DataFrame:
    """Use every core where the scan has fewer splits than cores; else no exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text", "lang", "source"))))


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``rel_path, ext`` derived from source, language and number."""
    d = documents(spark, sf_dir).withColumn("ext", pick(EXTENSIONS, F.col("doc_id")))
    name = F.format_string("%08d", F.col("doc_id"))
    return d.withColumn("rel_path", F.concat_ws("/", "source", "lang", F.concat(name, F.col("ext"))))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like :func:`corpus`, without reading the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn(
        "ext", pick(EXTENSIONS, F.col("doc_id")))
    name = F.format_string("%08d", F.col("doc_id"))
    return d.withColumn("rel_path", F.concat_ws("/", "source", "lang", F.concat(name, F.col("ext"))))


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation (left) with the turn that follows it (right)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    left = c.select("conv_id", F.col("turn").alias("t"), F.col("text").alias("left_text"))
    right = c.select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("right_text"))
    pair = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("t").cast("string"))
    return left.join(right, ["conv_id", "t"]).select(pair.alias("pair_id"), "left_text", "right_text")
