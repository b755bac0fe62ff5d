"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def components(links: DataFrame) -> DataFrame:
    """id, root (the least id of the component), as a table of its own, of every id in ``links`` (columns a, b: long).

    Labels live in tables; the driver sees one count for each round.  A round takes each id's least label among its
    neighbours and then the label of that label, so paths halve and rounds grow with their logarithm.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("of")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("of")))
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy("id").agg(F.least("id", F.min("of")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("of"), "root"), "of").groupBy("id").agg(F.min("root").alias("near"))
        new = labels.select("id", "root").join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        of = labels.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        before, labels = labels, materialize(new.join(of, "root", "left").select("id", "old", F.least("root", F.coalesce("beyond", "root")).alias("root")), "labels")
        drop(before)
        if labels.filter("old <> root").isEmpty():
            drop(both)
            return labels
