"""Connected components of a table of links, in rounds of joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import narrow


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for each id of ``links(a, b)``: the least id that links reach.

    Each round gives an id the least label among its neighbours and then the
    label of its label, so the labels of a component of diameter d agree after
    about log d rounds. Minima are taken before each shuffle; the join of a much
    linked id is a skewed join, which AQE splits. Only a count of changes comes
    to the driver.
    """
    both = links.where("a is not null and b is not null and a <> b")
    both = narrow(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        above = hooked.select(F.col("id").alias("up"), F.col("component").alias("top"))
        jumped = hooked.join(above, F.col("component") == F.col("up")).select("id", "old", F.least("component", "top").alias("component"))
        jumped = narrow(jumped, "labels")
        labels = jumped.select("id", "component")
        if not jumped.where("old <> component").limit(1).count():
            return labels
