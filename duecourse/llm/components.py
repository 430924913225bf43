"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of any direction, repeated or not, to (id, component): each id with the least id it reaches.

    Rounds of two steps: take the least label among the neighbours, then the label of that label, so a chain of n ids
    takes about log n rounds. Labels are written to the shared folder each round; nothing but a count reaches the driver.
    Links of an id with itself, or with null at either end, say nothing and give no row; an empty table gives no rows.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "edges")
    labels = held = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = staged(hooked.join(root, "component").select("id", F.least("component", "root").alias("component"), "was"), "labels")
        discard(held)
        if new.where("component != was").isEmpty():
            discard(edges)
            return new.select("id", "component")
        labels, held = new.select("id", "component"), new
