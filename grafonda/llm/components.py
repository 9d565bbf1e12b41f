"""Connected components of an edge table, all on the executors.

Each round every node takes the smallest label among its own and its neighbours', then the label of its label (pointer
jumping), so long chains shrink fast. Sums per node are partial before they are shuffled and hubs sit on the skew-splittable
side of a join; nothing but the number of changed labels reaches the driver. A round's labels are written to the shared
folder, so lineage never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, work_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that it is linked to, for all nodes of edges. Loops (a = b) are allowed; nulls are left out;
    repeated edges count once; no edges give an empty result; other columns of edges are not looked at."""
    pairs = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null")
    both = work_table(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    held = work_table(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("root"), F.lit(0).cast("long").alias("old")), "labels")
    while True:
        labels = held.select("node", "root")
        heard = both.join(labels.select(F.col("node").alias("src"), "root"), "src").groupBy("dst").agg(F.min("root").alias("heard"))
        hooked = labels.join(heard, labels["node"] == heard["dst"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("heard", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = work_table(hooked.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "labels")
        forget(held)
        held = new
        if not new.where("root <> old").limit(1).count():
            forget(both)
            return new.select("node", "root")
