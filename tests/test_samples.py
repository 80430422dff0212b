"""The six seeded sample generators (shape, size, planted structure)."""

from pyspark.sql import functions as F

from tablelens.sources import samples as sm


def test_generators_shapes(spark):
    expected = {"passenger_survival": (300, "Survived"), "house_prices": (300, "MedHouseVal"),
                "card_fraud": (2000, "Class"), "unlabelled_flowers": (150, "petal_width"),
                "monthly_passengers": (96, "Passengers"), "messy_export": (210, "target_leak")}
    for name, (rows, col) in expected.items():
        df = sm.GENERATORS[name](spark)
        assert df.count() == rows and col in df.columns, name


def test_generators_are_reproducible_and_scalable(spark):
    a = sm.card_fraud(spark, n=5000).agg(F.sum("Amount")).first()[0]
    b = sm.card_fraud(spark, n=5000).agg(F.sum("Amount")).first()[0]
    assert a == b
    share = sm.card_fraud(spark, n=20000).agg(F.avg("Class")).first()[0]
    assert 0.003 < share < 0.02


def test_messy_export_duplicates_and_months(spark):
    m = sm.messy_export(spark)
    assert m.count() - m.distinct().count() == 10
    months = [r["Month"] for r in sm.monthly_passengers(spark).orderBy("Month").collect()]
    assert months[0] == "2015-01" and months[-1] == "2022-12"
