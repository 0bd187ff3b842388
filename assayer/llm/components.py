"""Connected components by hooking to the smallest neighbour and pointer jumping."""

from pyspark.sql import DataFrame, functions as F

from assayer.session import durable


def components(edges: DataFrame) -> DataFrame:
    """Union-find over rows (a, b): each node but the smallest of its component
    with that smallest node, as (node, root).

    A round hooks each node to its smallest neighbour, shortens the paths by
    doubling and contracts the edges, so their number falls at least by half in
    terms of nodes. All tables are cut from their lineage by a reliable
    checkpoint, which also leaves both sides of the joins on a hot node free to
    be split. Rows with a null are no edge.
    """
    rest = durable(_ordered(edges.select("a", "b")))
    found = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("root")).union(rest.select("b", "a"))
        hook = durable(both.groupBy("node").agg(F.min("root").alias("root")).where("root < node"))
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = durable(hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = hook
        else:
            found = durable(_renamed(found, hook, "root").select("node", "root").union(hook))
        rest = durable(_ordered(_renamed(_renamed(rest, hook, "a"), hook, "b")))
    if found is None:
        kind = dict(edges.dtypes)["a"]
        found = edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return found


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _renamed(df: DataFrame, hook: DataFrame, column: str) -> DataFrame:
    to = hook.select(F.col("node").alias(column), F.col("root").alias("__to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")
