"""Sample datasets (S12): six seeded generators with a scalable row count.

Each is ``spark.range(n)`` plus ``rand(seed)`` / ``randn(seed)`` columns, so
the data is generated in parallel and is reproducible for a fixed partition
count. The shapes follow the reference's demo tables; the random numbers do
not (a different generator), only their distributions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42


def passenger_survival(spark: SparkSession, n: int = 300, seed: int = SEED) -> DataFrame:
    """Binary target ``Survived`` with a leak-named column ``survival_status_final``."""
    base = spark.range(n).select((F.col("id") + 1).alias("PassengerId"))
    pclass = (F.floor(F.rand(seed) * 3) + 1).cast("int")
    sex = F.when(F.rand(seed + 1) < 0.5, "male").otherwise("female")
    age = F.when(F.rand(seed + 2) < 0.1, F.lit(None)).otherwise(F.round(F.abs(30 + 14 * F.randn(seed + 3)), 1))
    fare = F.round(F.exp(2.5 + F.randn(seed + 4)), 2)
    emb = F.element_at(F.array(F.lit("S"), F.lit("C"), F.lit("Q")), (F.floor(F.rand(seed + 5) * 3) + 1).cast("int"))
    df = base.select("PassengerId", pclass.alias("Pclass"), sex.alias("Sex"), age.alias("Age"),
                     fare.alias("Fare"), emb.alias("Embarked"))
    logit = 1.5 - 0.9 * F.col("Pclass") + F.when(F.col("Sex") == "female", 2.0).otherwise(0.0)
    surv = (F.rand(seed + 6) < 1 / (1 + F.exp(-logit))).cast("int")
    df = df.withColumn("Survived", surv)
    return df.withColumn("survival_status_final", F.when(F.col("Survived") == 1, "survived").otherwise("died"))


def house_prices(spark: SparkSession, n: int = 300, seed: int = SEED) -> DataFrame:
    """Regression target ``MedHouseVal``."""
    df = spark.range(n).select(
        F.round(F.abs(3.5 + 1.5 * F.randn(seed)), 4).alias("MedInc"),
        (F.floor(F.rand(seed + 1) * 51) + 1).cast("int").alias("HouseAge"),
        F.round(F.abs(5 + F.randn(seed + 2)), 3).alias("AveRooms"),
        (F.floor(F.rand(seed + 3) * 3000) + 100).cast("int").alias("Population"),
        F.round(32 + 10 * F.rand(seed + 4), 2).alias("Latitude"),
        F.round(-124 + 10 * F.rand(seed + 5), 2).alias("Longitude"))
    return df.withColumn("MedHouseVal", F.round(0.45 * F.col("MedInc") + 0.01 * F.col("HouseAge")
                                                + 0.3 * F.randn(seed + 6), 3))


def card_fraud(spark: SparkSession, n: int = 2000, seed: int = SEED) -> DataFrame:
    """Binary target ``Class`` with about 1 % ones."""
    cols = [F.randn(seed + i).alias(f"V{i + 1}") for i in range(5)]
    df = spark.range(n).select(*cols, F.round(F.exp(3 + F.randn(seed + 9)), 2).alias("Amount"),
                               (F.rand(seed + 10) < 0.01).cast("int").alias("Class"))
    return df.withColumn("V1", F.col("V1") - 3 * F.col("Class"))


def unlabelled_flowers(spark: SparkSession, n: int = 150, seed: int = SEED) -> DataFrame:
    """Three clusters, no target."""
    centers = [(5.0, 3.4, 1.5, 0.2), (5.9, 2.8, 4.3, 1.3), (6.6, 3.0, 5.6, 2.0)]
    g = (F.col("id") % 3).cast("int")
    cols = []
    for j, name in enumerate(["sepal_length", "sepal_width", "petal_length", "petal_width"]):
        center = F.element_at(F.array(*[F.lit(c[j]) for c in centers]), g + 1)
        cols.append(F.round(center + 0.3 * F.randn(seed + j), 2).alias(name))
    return spark.range(n).select(*cols)


def monthly_passengers(spark: SparkSession, n: int = 96, seed: int = SEED) -> DataFrame:
    """Time series: ``Month`` text yyyy-MM from 2015-01, trend plus yearly season."""
    t = F.col("id").cast("double")
    month = F.date_format(F.add_months(F.lit("2015-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM")
    val = 100 + 300 * t / max(n - 1, 1) + 30 * F.sin(2 * math.pi * t / 12) + 8 * F.randn(seed)
    return spark.range(n).select(month.alias("Month"), F.round(val).cast("int").alias("Passengers"))


def messy_export(spark: SparkSession, n: int = 200, duplicates: int = 10, seed: int = SEED) -> DataFrame:
    """Mixed-type text column, a leaking numeric column and ``duplicates`` repeated rows."""
    base = spark.range(n).select(
        (F.col("id") + 1).alias("id"),
        F.when(F.col("id") % 5 == 0, F.lit("n/a")).otherwise((F.col("id") * 7 % 100).cast("string")).alias("mixed_type_col"),
        F.round(50 + 10 * F.randn(seed), 2).alias("score"),
        (F.rand(seed + 1) < 0.3).cast("int").alias("target"))
    base = base.withColumn("target_leak", F.round(100 * F.col("target") + F.randn(seed + 2), 3))
    return base.unionByName(base.where(F.col("id") <= duplicates))


GENERATORS = {"passenger_survival": passenger_survival, "house_prices": house_prices,
              "card_fraud": card_fraud, "unlabelled_flowers": unlabelled_flowers,
              "monthly_passengers": monthly_passengers, "messy_export": messy_export}
