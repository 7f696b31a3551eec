"""The three runs: train, predict, evaluate."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import blocking, clustering, metrics, profiles, sampling
from kinweave.operators import features as features_of
from kinweave.session import Scratch
from kinweave.sources.files import Config, drop_labels


#: Rows that one task holds while trees are grown: a step makes several small jobs, whose time is that of their tasks' start,
#: so tasks follow the rows and not the partitions they were shuffled into.
TRAIN_ROWS = 1 << 14


@dataclass
class Linked:
    """What a run derives from events."""

    profiles: DataFrame
    sites: DataFrame
    categories: DataFrame


def link_profiles(events: DataFrame, scratch: Scratch, split: bool = False, seed: int = 42) -> Linked:
    clean = scratch.save(profiles.preprocess(events))
    made = profiles.passports(clean)
    if split:
        of = sampling.entity_split(clean.select("entity_id", "entity_type").where("entity_id is not null").distinct(), seed=seed)
        made = made.join(of.select("entity_id", "split"), "entity_id", "left")
    return Linked(scratch.save(made), scratch.save(profiles.site_index(clean)), scratch.save(profiles.category_index(clean)))


def fit(train: DataFrame, config: Config, validation: DataFrame | None = None) -> PipelineModel:
    """A boosted classifier on labelled features; missing time differences count as -1. With validation rows, the trees
    up to the first step that makes their loss worse, as Spark's own validation keeps them with a tolerance of 0."""
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxDepth=config.max_depth, stepSize=config.learning_rate, maxIter=config.trees, seed=config.seed)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(features_of.NAMES), outputCol="features"), trees])
    model = pipeline.fit(weighed(packed(train, TRAIN_ROWS), config))
    return model if validation is None else shortened(model, helpful_steps(validation_losses(model.stages[-1], weighed(validation, config))))


def weighed(rows: DataFrame, config: Config) -> DataFrame:
    return filled(rows).withColumns({"weight": F.when(F.col("label") == 1, config.positive_weight).otherwise(1.0), "label": F.col("label").cast("double")})


def nodes(boosted: GBTClassificationModel) -> list:
    """Each tree as (feature, threshold, left, right) down to the leaves' values."""
    lines = iter(re.findall(r"(Tree|If|Else|Predict)\b:?(?: \(feature (\d+) (?:<=|>) (\S+)\)| (\S+))", boosted.toDebugString))

    def below():
        kind, feature, threshold, value = next(lines)
        if kind == "Predict":
            return float(value)
        left = below()
        next(lines)  # its Else
        return int(feature), float(threshold), left, below()

    return [below() for kind, *_ in lines if kind == "Tree"]


def validation_losses(boosted: GBTClassificationModel, rows: DataFrame) -> list[float]:
    """The mean weighted loss of the rows after each step, all steps in one pass; Spark's own validation makes a pass a step."""
    steps = list(zip(nodes(boosted), boosted.treeWeights))

    def leaf(node, x):
        return np.where(x[node[0]] <= node[1], leaf(node[2], x), leaf(node[3], x)) if isinstance(node, tuple) else node

    def summed(batches):
        total, weights = np.zeros(len(steps)), 0.0
        for pdf in batches:
            x = [pdf[n].to_numpy(float) for n in features_of.NAMES]
            sign, weight = 2 * pdf["label"].to_numpy() - 1, pdf["weight"].to_numpy()
            margin, weights = np.zeros(len(pdf)), weights + weight.sum()
            for k, (tree, step) in enumerate(steps):
                margin += step * leaf(tree, x)
                total[k] += weight @ np.logaddexp(0, -2 * sign * margin)
        yield pd.DataFrame({"step": np.arange(len(steps)), "loss": 2 * total, "weight": weights})

    of = rows.select("label", "weight", *features_of.NAMES).mapInPandas(summed, "step long, loss double, weight double")
    return [r.loss for r in of.groupBy("step").agg(F.try_divide(F.sum("loss"), F.sum("weight")).alias("loss")).orderBy("step").collect()]


def helpful_steps(losses: list[float | None]) -> int | None:
    """Steps up to the best one before the first that is worse than the best so far; None without rows to judge by."""
    if not losses or None in losses:
        return None
    best = 0
    for k, loss in enumerate(losses):
        if loss > losses[best]:
            break
        if loss < losses[best]:
            best = k
    return best + 1


def shortened(model: PipelineModel, steps: int | None) -> PipelineModel:
    """The model of its first `steps` trees, or of all."""
    *before, boosted = model.stages
    if steps in (None, boosted.getNumTrees):
        return model
    old, gateway = boosted._java_obj, SparkContext._active_spark_context._gateway
    ml, all_trees = gateway.jvm.org.apache.spark.ml, old.trees()
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, steps), gateway.new_array(gateway.jvm.double, steps)
    for k in range(steps):
        trees[k], weights[k] = all_trees[k], boosted.treeWeights[k]
    made = ml.classification.GBTClassificationModel(old.uid(), trees, weights, old.numFeatures(), old.numClasses())
    out = GBTClassificationModel(old.copyValues(made, ml.param.ParamMap.empty()))
    out._transfer_params_from_java()
    return PipelineModel([*before, out])


def packed(rows: DataFrame, each: int) -> DataFrame:
    """All rows, dealt out evenly to as many tasks as hold `each` of them."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def filled(rows: DataFrame) -> DataFrame:
    return rows.fillna({"last_event_diff_days": -1.0})


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Append p."""
    out = model.transform(filled(rows)).withColumn("p", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def train(events: DataFrame, config: Config) -> tuple[PipelineModel, dict]:
    """A model and its report, evaluated on the test split."""
    scratch = Scratch(events.sparkSession)
    data = link_profiles(events, scratch, split=True, seed=config.seed)
    rows, report = {}, {"config": asdict(config)}
    for part in ("train", "val", "test"):
        own = data.profiles.where(F.col("split") == part)
        sites = data.sites.join(own.select("profile_id"), "profile_id", "left_semi")
        pairs = scratch.save(blocking.label_pairs(blocking.candidate_pairs(own, sites, config.block_cap), own))
        report[f"blocking_{part}"] = blocking.blocking_recall(pairs, own).first().asDict()
        if part == "train":
            pairs = scratch.save(sampling.balance(pairs, config.negative_ratio, config.seed))
        built = features_of.build_features(pairs, data.profiles, data.sites, scratch)
        rows[part] = scratch.save(built.join(pairs, ["a", "b"]))
    model = fit(rows["train"], config, rows["val"])
    scored = scratch.save(score(model, rows["test"]).select("a", "b", "p", "label"))
    report["pairs"] = metrics.classification_report(scored.withColumn("predicted", (F.col("p") >= config.match_threshold).cast("int"))).first().asDict()
    clusters = scratch.save(clustering.cluster(scored, config.cluster_threshold, config.cluster_method, scratch))
    labels = data.profiles.where("split = 'test'").select("profile_id", "entity_id")
    found = scratch.save(clustering.evaluate(clusters, labels, scored))
    report["clusters"] = clustering.recovery(found, clusters, labels, scored).first().asDict()
    return model, report


def predict(events: DataFrame, model: PipelineModel, config: Config) -> tuple[DataFrame, DataFrame]:
    """(auto, review). Without candidate pairs every profile is its own entity."""
    scratch = Scratch(events.sparkSession)
    data = link_profiles(drop_labels(events), scratch)
    pairs = scratch.save(blocking.candidate_pairs(data.profiles, data.sites, config.block_cap))
    scored = scratch.save(score(model, features_of.build_features(pairs, data.profiles, data.sites, scratch)).select("a", "b", "p"))
    clusters = scratch.save(clustering.cluster(scored, config.cluster_threshold, config.cluster_method, scratch))
    stats = scratch.save(clustering.confidence(clusters, scored, config.confidence_threshold))
    return clustering.outputs(clusters, stats, data.profiles)


def evaluate(events: DataFrame, model: PipelineModel, config: Config) -> dict | None:
    """The labelled report; None without candidate pairs."""
    if "entity_id" not in events.columns:
        raise ValueError("entity_id is needed")
    scratch = Scratch(events.sparkSession)
    data = link_profiles(events, scratch)
    pairs = scratch.save(blocking.label_pairs(blocking.candidate_pairs(data.profiles, data.sites, config.block_cap), data.profiles))
    if pairs.isEmpty():
        return None
    built = features_of.build_features(pairs, data.profiles, data.sites, scratch)
    scored = scratch.save(score(model, built.join(pairs, ["a", "b"])).select("a", "b", "p", "label"))
    clusters = scratch.save(clustering.cluster(scored, config.cluster_threshold, config.cluster_method, scratch))
    labels = data.profiles.select("profile_id", "entity_id")
    found = scratch.save(clustering.evaluate(clusters, labels, scored))
    return {
        "blocking": blocking.blocking_recall(pairs, labels).first().asDict(),
        "pairs": metrics.classification_report(scored.withColumn("predicted", (F.col("p") >= config.match_threshold).cast("int"))).first().asDict(),
        "clusters": clustering.recovery(found, clusters, labels, scored).first().asDict(),
        "true_sizes": [tuple(r) for r in metrics.size_histogram(labels, "entity_id").collect()],
        "cluster_sizes": [tuple(r) for r in metrics.size_histogram(clusters, "cluster_id").collect()],
    }
