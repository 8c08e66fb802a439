"""An append-only lineage: immutable records by key, and what leads to a record or follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.pit import whole_row
from panelforge.sources.store import held


class LineageConflict(ValueError):
    """A key that is known with another payload."""


def payload_hash(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON, columns by name, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def conflicts(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in existing or new rows with more than one payload and that `new` would touch, with their number of payloads."""
    both = existing.select(*keys, payload_hash(existing).alias("__h"), F.lit(0).alias("__new")).unionByName(new.select(*keys, payload_hash(new).alias("__h"), F.lit(1).alias("__new")))
    found = both.groupBy(*keys, "__h").agg(F.max("__new").alias("__new")).groupBy(*keys).agg(F.count(F.lit(1)).alias("payloads"), F.max("__new").alias("__new"))
    return found.filter("payloads > 1 and __new = 1").drop("__new")


def appended(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` to add, one of each key, with their payload_hash: a record that is there already adds nothing, one with another payload raises LineageConflict and nothing is added.

    existing holds the same columns as new.
    """
    bad = conflicts(existing.select(new.columns), new, keys).limit(5).collect()
    if bad:
        raise LineageConflict(f"{len(bad)} or more keys with another payload: {[tuple(r[k] for k in keys) for r in bad]}")
    from pyspark.sql import Window as W

    one = new.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(whole_row(new)))).filter("__n = 1").drop("__n")
    return one.join(existing.select(*keys), keys, "left_anti").withColumn("payload_hash", payload_hash(new))


def reached(edges: DataFrame, roots: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """(root, node, depth): nodes that edges reach from each root, at their least depth; the root itself at 0.

    Descendants follow source to target, ancestors the other way round. Rounds are joins whose results are written, so lineage of the
    plan stays short; nodes that a root has met are left out of its next round, so cycles end. `most` bounds the depth.
    """
    e = edges.select(F.col(source).alias("node"), F.col(target).alias("__to")).filter("node is not null and __to is not null").distinct()
    seen = held(roots.select(F.col(roots.columns[0]).alias("root")).filter("root is not null").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "reached")
    front, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = front.join(e, "node").select("root", F.col("__to").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = held(step.select("root", "node", F.lit(depth).alias("depth")), "reached")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def projected(edges: DataFrame, nodes: DataFrame, source: str, target: str) -> DataFrame:
    """The edges whose two ends are among the nodes (column node)."""
    n = nodes.select("node").distinct()
    return edges.join(n, edges[source] == n["node"], "left_semi").join(n, edges[target] == n["node"], "left_semi")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that undirected edges connect a node with.

    Each round a node takes the least label among its neighbours' and its own and then that label's label, so labels travel by doubling;
    rounds are joins whose results are written. Ends when no label moves. Edges with a null end are left out.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    e = held(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    at = held(e.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("component")), "components")
    while True:
        near = e.join(at.select(F.col("node").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        step = at.join(near, "node").select("node", F.least("component", "c").alias("to"), "component")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        now = held(step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("next", "to")).alias("component"), (F.least("to", F.coalesce("next", "to")) != F.col("component")).alias("moved")), "components")
        at = now.select("node", "component")
        if not now.filter("moved").limit(1).count():
            return at
