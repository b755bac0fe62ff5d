"""Queries of the engagement engine take every row of their tables."""

from pyspark.sql import functions as F

from parley.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_event_is_cleaned_and_in_a_file(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    cleaned = registry.QUERIES["cleaned_messages"](spark, SF)
    assert cleaned.agg(F.sum("raw")).first()[0] == n
    assert not cleaned.filter("contains(relevant, 'hello!')").isEmpty()
    files = registry.QUERIES["chat_file_containment"](spark, SF)
    assert files.filter("kept").agg(F.sum("n_keys")).first()[0] == n
