"""Driver tables re-read as the engine's inputs, with the SQL for the same views.

* ``pair``: one row per event with two synthetic expert scores (k/4000, exact in both engines)
* ``predictions``: the pair in long form, one row per method
* ``signals``: the 64-value vectors as fixed-length signals
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("temporal", "spectral")
THRESHOLDS = {"temporal": 0.45, "spectral": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    y = (F.col("event_type") == "error").cast("int")
    noise_t = (F.col("event_id") * 7919 + 13) % 1000
    noise_s = (F.col("event_id") * 104729 + 7) % 1000
    drift = F.floor("value") % 500
    return e.select(
        F.col("event_id").alias("sample_id"),
        F.col("user_id").alias("id_measurement"),
        (F.col("event_id") % 3).cast("string").alias("phase"),
        y.alias("target"),
        (F.lit(42) + (F.col("event_id") % 3).cast("int")).alias("seed"),
        F.when(F.col("event_id") % 5 == 0, "validation").otherwise("train_oof").alias("split"),
        ((noise_t * 3 + 1000 * y).cast("double") / 4000.0).alias("p_temporal"),
        ((noise_s * 2 + 1500 * y + drift).cast("double") / 4000.0).alias("p_spectral"),
    ).withColumns(
        {
            "d_temporal": (F.col("p_temporal") >= THRESHOLDS["temporal"]).cast("int"),
            "d_spectral": (F.col("p_spectral") >= THRESHOLDS["spectral"]).cast("int"),
        }
    )


PAIR = """
pair AS (
  SELECT *, CAST(p_temporal >= 0.45 AS INT) AS d_temporal, CAST(p_spectral >= 0.5 AS INT) AS d_spectral
  FROM (
    SELECT event_id AS sample_id, user_id AS id_measurement, CAST(event_id % 3 AS VARCHAR) AS phase,
      CAST(event_type = 'error' AS INT) AS target, 42 + CAST(event_id % 3 AS INT) AS seed,
      CASE WHEN event_id % 5 = 0 THEN 'validation' ELSE 'train_oof' END AS split,
      (((event_id * 7919 + 13) % 1000) * 3 + 1000 * CAST(event_type = 'error' AS INT))::DOUBLE / 4000.0::DOUBLE AS p_temporal,
      (((event_id * 104729 + 7) % 1000) * 2 + 1500 * CAST(event_type = 'error' AS INT)
        + CAST(floor(value) AS BIGINT) % 500)::DOUBLE / 4000.0::DOUBLE AS p_spectral
    FROM events))
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table; both method rows come from one scan through ``explode``."""
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("method"),
                    F.col(f"p_{m}").alias("probability"),
                    F.lit(THRESHOLDS[m]).alias("threshold"),
                    F.col(f"d_{m}").alias("prediction"),
                )
                for m in METHODS
            ]
        )
    )
    return pair(spark, sf_dir).select(
        "sample_id", "id_measurement", "phase", "target", F.lit("wide").alias("dataset"), "split", "seed",
        rows.alias("r"),
    ).select("*", "r.*").drop("r")


PREDICTIONS = (
    PAIR
    + """,
predictions AS (
  SELECT sample_id, id_measurement, phase, target, 'wide' AS dataset, split, seed, 'temporal' AS method,
    p_temporal AS probability, 0.45::DOUBLE AS threshold, d_temporal AS prediction FROM pair
  UNION ALL
  SELECT sample_id, id_measurement, phase, target, 'wide', split, seed, 'spectral', p_spectral, 0.5::DOUBLE, d_spectral FROM pair)
"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large score table: every order line as a scored sample, grouped by order."""
    l = table(spark, sf_dir, "lineitem")
    score = F.round(F.col("l_discount") * 100) * 20 + F.round(F.col("l_tax") * 100) * 10 + F.col("l_quantity") * 2
    other = F.round(F.col("l_tax") * 100) * 30 + F.col("l_quantity") * 3
    return l.select(
        "l_orderkey",
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        F.col("l_linestatus").alias("method"),
        (score.cast("double") / 400.0).alias("probability"),
        (other.cast("double") / 400.0).alias("probability_b"),
    ).withColumn("threshold", F.lit(0.5))


LINES = """
lines AS (
  SELECT l_orderkey, CAST(l_returnflag = 'R' AS INT) AS target, l_linestatus AS method,
    (round(l_discount * 100) * 20 + round(l_tax * 100) * 10 + l_quantity * 2)::DOUBLE / 400.0::DOUBLE AS probability,
    (round(l_tax * 100) * 30 + l_quantity * 3)::DOUBLE / 400.0::DOUBLE AS probability_b,
    0.5::DOUBLE AS threshold
  FROM lineitem)
"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length array signals; class 1 = label below 5, group = vec_id div 3."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.floor(F.col("vec_id") / 3).cast("bigint").alias("id_measurement"),
        (F.col("vec_id") % 3).cast("string").alias("phase"),
        (F.col("label") < 5).cast("int").alias("target"),
        F.when(F.col("vec_id") % 4 == 0, "validation").otherwise("train").alias("split"),
        (F.floor(F.col("vec_id") / 3) % 5).cast("int").alias("fold"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


SIGNALS = """
signals AS (
  SELECT vec_id AS sample_id, vec_id // 3 AS id_measurement, CAST(vec_id % 3 AS VARCHAR) AS phase,
    CAST(label < 5 AS INT) AS target, CASE WHEN vec_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split,
    CAST((vec_id // 3) % 5 AS INT) AS fold, embedding::DOUBLE[] AS vals FROM embeddings),
samples AS (
  SELECT sample_id, id_measurement, phase, target, split, fold,
    generate_subscripts(vals, 1) - 1 AS i, unnest(vals) AS v FROM signals)
"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal metadata: three consecutive events form a measurement with phases 0, 1, 2."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("sample_id"),
        F.floor(F.col("event_id") / 3).cast("bigint").alias("id_measurement"),
        (F.col("event_id") % 3).cast("string").alias("phase"),
        (F.col("event_type") == "error").cast("int").alias("target"),
        F.col("event_type"),
        F.col("value").alias("x"),
    )


TRIPLES = """
triples AS (SELECT event_id AS sample_id, event_id // 3 AS id_measurement, CAST(event_id % 3 AS VARCHAR) AS phase,
  CAST(event_type = 'error' AS INT) AS target, event_type, value AS x FROM events)
"""
