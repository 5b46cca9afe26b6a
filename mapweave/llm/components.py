"""Connected components of an undirected graph, wholly on the executors.

Each round every vertex takes the least of its neighbours and itself as its new
name; edges are renamed and loops and repeats dropped. Two rounds take the least
id, which folds stars (what the joins here make) at once; every third
takes the least under a random order drawn anew, which shrinks any graph,
long paths too, by a constant factor. So the rounds grow with the logarithm of
the graph at worst. Minima are combined before the shuffle, and the renaming
joins feed an exchange rather than an aggregate on the same key, so that adaptive
execution can split the partition of a vertex with very many edges. Names and
edges of every round are written to the shared folder; the names are put together
at the end, from the last and smallest round to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``edges`` (a long, b long) to (id long, component long) for each vertex with an edge.

    ``component`` is the smallest id of the component. Null ends and loops are
    ignored; no edge gives no row.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e, names = materialise(e.distinct(), "cc-edges"), []
    for rnd in range(max_rounds):
        if rnd and e.isEmpty():
            break
        sym = e.select("a", "b").union(e.select("b", "a")).toDF("u", "v")
        rank = lambda c: F.xxhash64(F.lit(rnd), F.col(c)) if rnd % 3 == 2 else F.col(c)
        key = lambda c: F.struct(rank(c).alias("h"), F.col(c).alias("x"))
        up = sym.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least("m", key("u"))["x"].alias("to"))
        up = materialise(up, "cc-up")
        names.append(up)
        left, right = up.toDF("a", "a2"), up.toDF("b", "b2")
        e = materialise(
            e.join(left, "a").select("a2", "b").join(right, "b").where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
            "cc-edges",
        )
    else:
        raise RuntimeError("components did not settle")
    label = names.pop().toDF("id", "label")
    for up in reversed(names):
        later = label.toDF("u2", "label")
        label = materialise(up.join(later, up["to"] == later["u2"], "left").select(F.col("u").alias("id"), F.coalesce("label", "to").alias("label")), "cc-label")
    least = label.groupBy("label").agg(F.min("id").alias("component"))
    return label.join(least, "label").select("id", "component")
