"""Clusters from pair probabilities: linkage inside connected components, confidence, evaluation."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components
from kinweave.session import Scratch

#: Largest component that one task may link; a larger one fails loudly rather than losing members.
MAX_COMPONENT = 20_000


def link(pairs: dict[tuple, float], threshold: float, method: str = "complete") -> list[list]:
    """Agglomerative linkage with distance 1 - p (1 where no pair), cut at p >= threshold; ties by smallest ids.

    single: components; complete: every pair across has p >= threshold; average: mean p over all
    pairs across, absent ones 0. Clusters of two or more, each sorted, by first member."""
    sums: dict = defaultdict(dict)
    for (a, b), p in pairs.items():
        sums[a][b] = sums[b][a] = p
    members = {x: [x] for x in sums}
    value = lambda a, b, s: s if method != "average" else s / (len(members[a]) * len(members[b]))
    heap = [(-p, min(a, b), max(a, b), 1, 1) for (a, b), p in pairs.items() if p >= threshold]
    heapq.heapify(heap)
    while heap:
        _, a, b, na, nb = heapq.heappop(heap)
        if a not in members or b not in members or len(members[a]) != na or len(members[b]) != nb:
            continue
        x, y = sums.pop(a), sums.pop(b)
        members[a] = sorted(members[a] + members.pop(b))
        near = (x.keys() & y.keys() if method == "complete" else x.keys() | y.keys()) - {a, b}
        merged = {}
        for c in near:
            merged[c] = min(x[c], y[c]) if method == "complete" else max(x.get(c, 0), y.get(c, 0)) if method == "single" else x.get(c, 0) + y.get(c, 0)
        for c in (x.keys() | y.keys()) - {a, b}:
            sums[c].pop(a, None)
            sums[c].pop(b, None)
            if c in merged:
                sums[c][a] = merged[c]
        sums[a] = merged
        for c, s in merged.items():
            if (p := value(a, c, s)) >= threshold:
                i, j = min(a, c), max(a, c)
                heapq.heappush(heap, (-p, i, j, len(members[i]), len(members[j])))
    return sorted(m for m in members.values() if len(m) > 1)


def cluster(scored: DataFrame, threshold: float = 0.95, method: str = "complete", scratch: Scratch | None = None, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(cluster_id, profile_id) from (a, b, p); a cluster's id is its smallest member. Repeated pairs count once, with
    the largest p. Only pairs with p >= threshold can join clusters, so each component is linked alone."""
    scratch = scratch or Scratch(scored.sparkSession)
    pairs = scratch.save(scored.groupBy("a", "b").agg(F.max("p").alias("p")))
    strong = pairs.where(F.col("p") >= threshold)
    comp = connected_components(strong, scratch)
    # A component is linked in one task: sizes are checked before any is gathered.
    widest = comp.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "component")).alias("m")).first().m
    if widest and widest.n > max_component:
        raise ValueError(f"component {widest.component} has {widest.n}, more than {max_component} members; raise the threshold or the limit")
    kind = scored.schema["a"].dataType.simpleString()
    # Average linkage also needs the weak pairs inside a component.
    edges = (pairs if method == "average" else strong).join(comp.select(F.col("node").alias("a"), "component"), "a")
    edges = edges.join(comp.select(F.col("node").alias("b"), F.col("component").alias("c2")), "b").where("component = c2").select("component", "a", "b", "p")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = link({(a, b): p for a, b, p in zip(pdf.a, pdf.b, pdf.p)}, threshold, method)
        return pd.DataFrame([(m[0], x) for m in found for x in m], columns=["cluster_id", "profile_id"])

    return edges.groupBy("component").applyInPandas(one, f"cluster_id {kind}, profile_id {kind}")


def confidence(clusters: DataFrame, scored: DataFrame, least: float = 0.99) -> DataFrame:
    """(cluster_id, size, avg_prob, min_prob, confident) over all member pairs; absent pairs count 0."""
    best = scored.groupBy("a", "b").agg(F.max("p").alias("p"))
    of = lambda e: clusters.select(F.col("profile_id").alias(e), F.col("cluster_id").alias(f"c{e}"))
    inside = best.join(of("a"), "a").join(of("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("cluster_id")).agg(F.sum("p").alias("s"), F.min("p").alias("m"), F.count("*").alias("k"))
    n = clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).join(inside, "cluster_id", "left")
    all_pairs = F.expr("size * (size - 1) / 2")
    avg = F.coalesce(F.try_divide("s", all_pairs), F.lit(0.0))
    low = F.when(F.col("k") == all_pairs, F.col("m")).otherwise(0.0)
    return n.select("cluster_id", "size", avg.alias("avg_prob"), low.alias("min_prob"), (avg >= least).alias("confident"))


def evaluate(clusters: DataFrame, labels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(entity_id, true_size, n_clusters, status) of each evaluated entity: two or more clustered (and blocked) profiles.

    perfect: one cluster of just its profiles; merged: one larger cluster; split: several."""
    known = clusters.join(labels, "profile_id").select("cluster_id", "profile_id", "entity_id")
    if pairs is not None:
        known = known.join(pairs.select(F.explode(F.array("a", "b")).alias("profile_id")).distinct(), "profile_id", "left_semi")
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    hit = known.groupBy("entity_id", "cluster_id").agg(F.count("*").alias("n")).join(sizes, "cluster_id")
    out = hit.groupBy("entity_id").agg(F.sum("n").alias("true_size"), F.count("*").alias("n_clusters"), F.max("size").alias("largest")).where("true_size >= 2")
    status = F.when(F.col("n_clusters") > 1, "split").when(F.col("largest") == F.col("true_size"), "perfect").otherwise("merged")
    return out.select("entity_id", "true_size", "n_clusters", status.alias("status"), (F.col("largest") > F.col("true_size")).alias("with_others"))


def recovery(evaluated: DataFrame, clusters: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of metrics; every ratio is 0 where nothing was evaluated."""
    blocked = labels.join(pairs.select(F.explode(F.array("a", "b")).alias("profile_id")).distinct(), "profile_id", "left_semi")
    in_blocking = blocked.groupBy("entity_id").agg(F.count("*").alias("n")).where("n >= 2").agg(F.count("*").alias("passed_blocking"))
    count = lambda s: F.count_if(F.col("status") == s)
    main = evaluated.agg(
        F.count("*").alias("evaluated"), count("perfect").alias("perfect"), count("merged").alias("merged"), count("split").alias("split"),
        F.count_if("with_others").alias("merged_with_others"),
    )
    n = clusters.select("cluster_id").distinct().agg(F.count("*").alias("clusters"))
    out = main.join(F.broadcast(in_blocking)).join(F.broadcast(n))
    return out.withColumns(
        {"lost": F.col("passed_blocking") - F.col("evaluated"), "partially_recovered": F.col("evaluated") - F.col("perfect"), "fully_broken": F.lit(0), "recovery_multi": F.coalesce(F.try_divide("perfect", "evaluated"), F.lit(0.0))}
    )


def outputs(clusters: DataFrame, stats: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(auto, review): confident clusters and every other profile as its own entity; clusters to review.

    Members of reviewed clusters are in both. Ids are stable: entity_ and review_ before the smallest member."""
    shown = ["first_name_clean", "last_name_clean", "email_domain", "phone_prefix", "geoname_id", "device", "osfamily", "country"]
    info = profiles.select("profile_id", *[F.coalesce(F.array_join(c, ", "), F.lit("")).alias(c) if profiles.schema[c].dataType.typeName() == "array" else F.col(c) for c in shown])
    full = clusters.join(stats, "cluster_id")
    numbers = [F.col("avg_prob").alias("avg_prob_in_cluster"), F.col("min_prob").alias("min_prob_in_cluster"), "size"]
    named = lambda p: F.concat(F.lit(p), F.col("cluster_id").cast("string"))
    sure = full.where("confident")
    auto = sure.select("profile_id", named("entity_").alias("predicted_entity_id"), *numbers)
    alone = profiles.select("profile_id").join(sure, "profile_id", "left_anti")
    own = F.concat(F.lit("entity_"), F.col("profile_id").cast("string"))
    alone = alone.select("profile_id", own.alias("predicted_entity_id"), F.lit(0.0).alias("avg_prob_in_cluster"), F.lit(0.0).alias("min_prob_in_cluster"), F.lit(1).cast("bigint").alias("size"))
    review = full.where("not confident").select(named("review_").alias("cluster_id"), "profile_id", *numbers)
    return auto.unionByName(alone).join(info, "profile_id", "left"), review.join(info, "profile_id", "left")
