"""Groups on a similarity graph: complete linkage by reciprocal neighbours, cohesion, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.components import connected_components
from ticketloom.session import discard, written


def complete_linkage(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, group_id, group_size): agglomeration by complete linkage, cut at the threshold of the edges.

    edges(a, b, similarity) are all pairs at the threshold or above, so two
    clusters may merge if and only if all their cross pairs are edges. In each
    round every cluster names the partner of the highest least similarity (the
    smaller id on ties), and clusters that name each other merge; for complete
    linkage this gives the sequential result. All steps are joins and
    aggregates over edges: no component is collected. group_id is the smallest
    member; nodes without edges are groups of one.
    """
    members = written(nodes.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(id_col).cast("bigint").alias("c")).distinct(), "members")
    links = written(edges.select("a", "b", F.round("similarity", 9).alias("s")), "links")
    while True:
        sizes = members.groupBy("c").agg(F.count("*").alias("n"))
        ca, cb = members.select(F.col("id").alias("a"), F.col("c").alias("x")), members.select(F.col("id").alias("b"), F.col("c").alias("y"))
        between = links.join(ca, "a").join(cb, "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "s").groupBy("x", "y").agg(F.count("*").alias("k"), F.min("s").alias("s"))
        full = between.join(sizes.select(F.col("c").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("c").alias("y"), F.col("n").alias("ny")), "y").where("k = nx * ny").select("x", "y", "s")
        both = full.unionByName(full.select(F.col("y").alias("x"), F.col("x").alias("y"), "s"))
        best = both.groupBy("x").agg(F.max(F.struct("s", (-F.col("y")).alias("m"))).alias("m")).select("x", (-F.col("m.m")).alias("y"))
        merges = written(best.alias("p").join(best.select(F.col("x").alias("y"), F.col("y").alias("back")), "y").where("back = x and x < y").select(F.col("y").alias("c"), F.col("x").alias("into")), "merges")
        if merges.isEmpty():
            discard(merges)
            break
        moved = written(members.join(merges, "c", "left").select("id", F.coalesce("into", "c").alias("c")), "members")
        discard(members)
        discard(merges)
        members = moved
    sizes = members.groupBy("c").agg(F.count("*").alias("group_size"))
    return members.join(sizes, "c").select(F.col("id").alias(id_col), F.col("c").alias("group_id"), "group_size")


def cohesion(groups: DataFrame, edges: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """(group_id, pairs, min_similarity, p05_similarity, median_similarity, mean_similarity, share_above) of groups of two or more, over their edges."""
    ga, gb = groups.select(F.col(id_col).alias("a"), F.col("group_id")), groups.select(F.col(id_col).alias("b"), F.col("group_id").alias("gb"))
    inside = edges.join(ga, "a").join(gb, "b").where("group_id = gb")
    return inside.groupBy("group_id").agg(F.count("*").alias("pairs"), F.min("similarity").alias("min_similarity"), F.expr("percentile(similarity, 0.05)").alias("p05_similarity"), F.expr("percentile(similarity, 0.5)").alias("median_similarity"), F.avg("similarity").alias("mean_similarity"), F.avg((F.col("similarity") >= threshold - 1e-6).cast("double")).alias("share_above"))


def group_names(groups: DataFrame, id_col: str, prefix: str = "semantic_complete_linkage") -> DataFrame:
    """(group_id, name): sha1 of the prefix and the group's sorted members, joined by bars; a group's members are few by construction."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.col(id_col).cast("bigint"))), lambda x: x.cast("string")), "|")
    return groups.where(F.col(id_col).isNotNull()).groupBy("group_id").agg(F.sha1(F.concat(F.lit(prefix + "|"), members)).alias("name"))


def grouping_summary(groups: DataFrame, edges: DataFrame, id_col: str = "vec_id", threshold: float = 0.0) -> DataFrame:
    """(records, edges, components, groups, multi_groups, grouped_records, largest, min_similarity, min_share, violations): one row.

    Nodes without edges are components of their own. violations: groups with a
    pair below the threshold, pairs that are no edge included; the least
    similarity and share are 1 where no group has two records.
    """
    parts = connected_components(edges)
    c = parts.agg(F.count("*").alias("linked"), F.count_distinct("component").alias("linked_components"))
    multi = F.col("group_size") > 1
    g = groups.agg(F.count("*").alias("records"), F.count_distinct("group_id").alias("groups"), F.count_distinct(F.when(multi, F.col("group_id"))).alias("multi_groups"), F.count_if(multi).alias("grouped_records"), F.max("group_size").alias("largest"))
    per = groups.where(multi).groupBy("group_id").agg(F.max("group_size").alias("n")).join(cohesion(groups, edges, id_col, threshold), "group_id", "left")
    whole = F.coalesce("pairs", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2
    v = per.agg(F.coalesce(F.min("min_similarity"), F.lit(1.0)).alias("min_similarity"), F.coalesce(F.min("share_above"), F.lit(1.0)).alias("min_share"), F.count_if(~whole | (F.coalesce("min_similarity", F.lit(0.0)) < threshold - 1e-6)).alias("violations"))
    out = g.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(v)).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    return out.select("records", "edges", (F.col("records") - F.col("linked") + F.col("linked_components")).alias("components"), "groups", "multi_groups", "grouped_records", "largest", "min_similarity", "min_share", "violations")


def not_nested(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """(inner, outers): groups of the one kind whose records are in several groups of the other kind; missing ids are in none."""
    return df.where(F.col(inner).isNotNull() & F.col(outer).isNotNull()).groupBy(inner).agg(F.count_distinct(outer).alias("outers")).where("outers > 1")
