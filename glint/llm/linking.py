"""Linking vertices that meet in buckets, and the connected components of the links.

A bucket (a prefix n-gram, a band of a signature) holds candidates of each other. Comparing all pairs within a bucket
grows with the square of its size, and the components don't need it: each member is first compared with the bucket's
pivot only, which is linear. What is linked is then one component, and the pairs still to be compared are those of a
bucket whose members are in different components. No pair that could join two components is left out, so the
components are exact.

Before a pair becomes a row it must pass what any linked pair passes: conditions on the members' sizes, places and
sketches, which the join itself evaluates. A sketch is a bitmap of a set's elements by hash; two of them differ in no
more bits than the sets differ in elements, whatever collides. So a group of near copies that aren't quite alike
enough costs comparisons of some longs within a join, but gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glint.llm.shared import Scratch

#: 64-bit words of a sketch, in the columns s0, s1, ...
SKETCH = 8
#: Turns of comparing with a pivot before the remaining pairs are compared.
PIVOT_TURNS = 1


def sketch_distance() -> str:
    """SQL: in how many bits the sketches of members a and b differ."""
    return "(" + " + ".join(f"bit_count(a_s{i} ^ b_s{i})" for i in range(SKETCH)) + ")"


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """vertex, component (the least vertex reachable) of every vertex of links (a, b: longs).

    Large-star and small-star steps alternate until every vertex is linked to its least one alone: O(log n) rounds in
    practice, each a shuffle of the remaining links, written to the shared folder; the round before is then deleted.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges, large)
        edges = after
        # done: each u has one v, and no v is itself linked to something less
        twice = edges.groupBy("u").count().where("count > 1").select("u")
        inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if twice.unionByName(inner).isEmpty():
            break
    roots = edges.select(F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    out = scratch.write(edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots))
    scratch.drop(edges)
    return out


def shared_buckets(members: DataFrame) -> DataFrame:
    """bucket, of (bucket, vertex) rows: those with different vertices. Aggregated before the shuffle."""
    return members.groupBy("bucket").agg(F.min("vertex").alias("lo"), F.max("vertex").alias("hi")).where("lo != hi").select("bucket")


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], may_link: str, scratch: Scratch, turns: int = PIVOT_TURNS) -> DataFrame:
    """vertex, component of all vertices that have a link.

    ``members``: distinct bucket and vertex, and what ``may_link``, SQL on the columns of members a and b (a_x, b_x),
    looks at. ``verify`` takes distinct pairs (a < b, and hub: the one of the two that was the pivot, which many pairs
    share) and returns a table of those that are linked.
    """
    columns = members.columns
    known = done = None
    for turn in range(turns + 1):
        if known is None:
            rows = members.withColumn("component", F.col("vertex"))
        else:
            rows = members.join(known, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
            mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
            rows = rows.join(mixed, "bucket", "left_semi")
        all_columns = [c for c in (*columns, "component") if c != "bucket"]
        named = lambda d, side: d.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in all_columns))
        if turn < turns:  # the pivot is the vertex that the most buckets have: the most like the others
            degree = rows.groupBy("vertex").agg(F.count("*").alias("_degree"))
            first = F.struct((-F.col("_degree")).alias("_d"), F.xxhash64("vertex").alias("_h"), *all_columns)
            other = rows.join(degree, "vertex").groupBy("bucket").agg(F.min(first).alias("p")).select("bucket", "p.*")
        else:
            rows = other = scratch.write(rows)
        pairs = named(rows, "a").join(named(other, "b"), "bucket").where(f"a_component != b_component and {may_link}")
        if turn == turns:
            pairs = pairs.where("a_vertex < b_vertex")
        pairs = pairs.groupBy(F.least("a_vertex", "b_vertex").alias("a"), F.greatest("a_vertex", "b_vertex").alias("b")).agg(F.max("b_vertex").alias("hub"))
        pairs = scratch.write(pairs if done is None else pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"))
        if turn == turns:
            scratch.drop(rows)
        scratch.release()  # the shuffles of members are by far the largest files
        if pairs.isEmpty():
            continue
        done = pairs
        found = verify(pairs).select("a", "b")
        if known is not None:  # what is linked already is one star for each component
            found = found.unionByName(known.select(F.col("vertex").alias("a"), F.col("component").alias("b")))
        before, known = known, components(found, scratch)
        if before is not None:
            scratch.drop(before)
    return known if known is not None else members.select("vertex", F.col("vertex").alias("component")).limit(0)
