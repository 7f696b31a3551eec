"""Truth tables, SQL equivalents and brute force for the engine's own operators."""

import itertools
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.functions import parsing as P
from kinweave.functions import scalars as X
from kinweave.operators import blocking, clustering, components, eda, features, metrics, profiles, sampling
from kinweave.operators.components import connected_components
from kinweave.plans import linkage
from kinweave.plans import queries as Q
from kinweave.session import Scratch
from kinweave.sources import files

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), con.execute(Q.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


CASES = [
    (X.normalize_email, " A b@X.org ", "ab@x.org"), (X.normalize_email, "a@b@c", None), (X.normalize_email, "none", None), (X.normalize_email, None, None),
    (X.email_domain, "a@B@c", "b"), (X.email_domain, "none", None),
    (X.normalize_phone, "9161234567", "79161234567"), (X.normalize_phone, "8 (916) 123-45-67", "79161234567"), (X.normalize_phone, "79161234567", "79161234567"),
    (X.normalize_phone, "99161234567", None), (X.normalize_phone, "791612345678", None), (X.normalize_phone, None, None), (X.phone_prefix, "9161234567", "7916"),
    (X.normalize_name, " Анна-Мария 2", "анна-мария"), (X.normalize_name, "O'Neil X", "o'neilx"), (X.normalize_name, "123", None),
    (X.normalize_date, "1990-02-01", "1990-02-01"), (X.normalize_date, "01.02.1990", "1990-01-02"), (X.normalize_date, "25.02.1990", "1990-02-25"), (X.normalize_date, "x", None),
    (X.normalize_bool, "Да", True), (X.normalize_bool, None, False), (X.to_id, "12.7", 12), (X.to_id, "abc", None), (X.to_id, "inf", None), (X.to_id, "0", 0), (X.to_id, "true", 1),
    (X.clean_category, "\t Ab ", "ab"), (X.clean_category, "  ", None),
]


def test_scalars(spark):
    frame = spark.range(1)
    got = frame.select(*[f(F.lit(v).cast("string")).alias(f"c{i}") for i, (f, v, _) in enumerate(CASES)]).first()
    assert list(got) == [w for *_, w in CASES]


@pytest.mark.parametrize("a, b, j", [([], [], 1.0), ([1], [], 0.0), ([1, 2], [2, 3], 1 / 3), ([1], [1], 1.0), (None, [1], 0.0), (None, None, 1.0)])
def test_jaccard(spark, a, b, j):
    frame = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert frame.select(X.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(j)


def test_string_similarities(spark):
    frame = spark.createDataFrame([("", ""), ("a", ""), ("анна", "анра"), ("a", "b"), (None, "x")], "a string, b string")
    got = [tuple(r) for r in frame.select(X.levenshtein_distance(F.col("a"), F.col("b")), X.char_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [(0, 1), (1, 1), (0.25, 0.2), (1, 1), (1, 1)]


def test_parsing(spark):
    frame = spark.createDataFrame([(["a:1", "a:2", "flag", "b:x:y", None], '{"day": 5}'), (None, "bad"), ([], None)], "f array<string>, j string")
    got = frame.select(P.key_values(F.col("f")).alias("m"), P.realtime(F.col("j"))["day"].alias("d"), P.json_map(F.col("j")).alias("x")).collect()
    assert got[0].m == {"a": "2", "flag": "true", "b": "x:y"} and got[0].d == 5 and got[0].x == {"day": "5"}
    assert got[1].m == {} and got[1].d is None and got[1].x == {} and got[2].m == {}


def test_latest_skips_nulls(spark):
    frame = spark.createDataFrame([("p", 1, "old"), ("p", 2, None), ("q", None, "x"), ("r", 1, "a"), ("r", 1, "b")], "id string, created_at int, v string")
    got = {r.id: r.v for r in frame.groupBy("id").agg(profiles.latest("v")).collect()}
    assert got == {"p": "old", "q": None, "r": "b"}


def test_block_cap(spark):
    frame = spark.createDataFrame([("k", i) for i in range(5)] + [("one", 9)], "key string, id int")
    got = {tuple(r) for r in blocking.pairs_within(frame, ["key"], "id", 3).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}


def test_recall_without_pairs(spark):
    none = spark.createDataFrame([], "a int, b int")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "profile_id int, entity_id string")
    assert blocking.blocking_recall(none, labels).first().recall == 1.0


@pytest.mark.parametrize("block", [1 << 18, 8])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (1, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in parent}


def naive_linkage(nodes, p, t):
    clusters = [frozenset([n]) for n in nodes]
    sim = lambda x, y: min(p.get((min(i, j), max(i, j)), 0) for i in x for j in y)
    while True:
        best = max(((sim(x, y), -min(x | y), -max(min(x), min(y)), x, y) for x, y in itertools.combinations(clusters, 2)), key=lambda b: b[:3], default=None)
        if not best or best[0] < t:
            return sorted(sorted(c) for c in clusters if len(c) > 1)
        clusters = [c for c in clusters if c not in best[3:]] + [best[3] | best[4]]


def test_complete_linkage(spark):
    rng = random.Random(4)
    for _ in range(60):
        p = {(i, j): rng.random() for i, j in itertools.combinations(range(10), 2) if rng.random() < 0.6}
        assert clustering.link(p, 0.5) == naive_linkage(range(10), p, 0.5)
    scored = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.98), (1, 3, 0.2), (5, 6, 0.97), (1, 2, 0.1)], "a int, b int, p double")
    got = {tuple(r) for r in clustering.cluster(scored, 0.95).collect()}
    assert got == {(1, 1), (1, 2), (5, 5), (5, 6)}
    with pytest.raises(Exception, match="more than 2 members"):
        clustering.cluster(scored, 0.95, max_component=2).collect()


def test_evaluation(spark):
    clusters = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4), (3, 9), (5, 5), (5, 8), (6, 6), (6, 7)], "cluster_id int, profile_id int")
    labels = spark.createDataFrame([(1, "p"), (2, "p"), (3, "m"), (4, "m"), (5, "s"), (6, "s"), (9, "z"), (11, "lost"), (12, "lost")], "profile_id int, entity_id string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (9, 3), (11, 12)], "a int, b int")
    found = clustering.evaluate(clusters, labels, pairs)
    assert {r.entity_id: r.status for r in found.collect()} == {"p": "perfect", "m": "merged", "s": "split"}
    row = clustering.recovery(found, clusters, labels, pairs).first()
    assert (row.evaluated, row.perfect, row.lost, round(row.recovery_multi, 3)) == (3, 1, 1, 0.333)
    assert clustering.recovery(found.limit(0), clusters, labels, pairs.limit(0)).first().recovery_multi == 0


def test_report_of_empty_rows(spark):
    row = metrics.classification_report(spark.createDataFrame([], "label int, predicted int")).first()
    assert row.accuracy == 0 and row.f1_1 == 0


def test_split_shares(spark):
    frame = spark.createDataFrame([(i, "s" if i % 4 else "m") for i in range(100)], "entity_id int, entity_type string")
    got = {(r.entity_type, r.split): r["count"] for r in sampling.entity_split(frame.repartition(7)).groupBy("entity_type", "split").count().collect()}
    assert got == {("s", "test"): 15, ("s", "val"): 15, ("s", "train"): 45, ("m", "test"): 5, ("m", "val"): 5, ("m", "train"): 15}


def test_overview(spark):
    frame = spark.createDataFrame([(["device: x", "browser:y"], "m", "1990-01-01")], "non_processing_features array<string>, sex string, birthday string")
    out = eda.overview(frame)
    assert out["device"].first()[0] == "x" and out["browser"].first()[0] == "y" and out["age"].first().n == 1


def test_files(spark, tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text("block_cap: 5  # cap\ncluster_method: 'single'\nunknown: 1\n")
    assert files.load_config(str(config)).block_cap == 5
    report = tmp_path / "r.json"
    report.write_text(json.dumps({"config": {"seed": 7}, "model_path": "/nowhere"}))
    active = files.set_active_experiment(str(config), str(report))
    assert files.active_experiment(active)[0].seed == 7 and files.active_experiment(active)[1] is None
    assert files.latest_parquet(spark, str(tmp_path)) is None
    frame = spark.createDataFrame([(1, None)], "entity_id int, x string")
    files.write_parquet(frame, str(tmp_path / "a.parquet"))
    assert files.latest_parquet(spark, str(tmp_path)).endswith("a.parquet")
    assert files.drop_labels(frame).columns == ["x"] and files.to_json_records(frame).first()[0] == '{"entity_id":1,"x":null}'
    assert files.preview(frame)["rows"] == 1


def test_predict_without_pairs_and_stream(spark, tmp_path):
    from kinweave.plans import linkage
    from kinweave.streaming import batches

    event = {"created_at": None, "first_name": "A", "last_name": None, "email": "a@b.c", "phone": None, "birthday": None, "sex": None, "non_processing_features": None, "realtime_features": None, "fs_features": None, "profile_id": "p"}
    import datetime

    event["created_at"] = datetime.datetime(2025, 1, 1)
    raw = spark.createDataFrame([tuple(event[f.name] for f in files.EVENT.fields)], files.EVENT)
    names = [f"{n}" for n in linkage.features_of.NAMES]
    toy = spark.createDataFrame([tuple([float(i % 2)] * len(names) + [i % 2]) for i in range(20)], ", ".join(f"{n} double" for n in names) + ", label int")
    model = linkage.fit(toy, files.Config(trees=1))
    auto, review = linkage.predict(raw, model, files.Config())
    assert [r.predicted_entity_id for r in auto.collect()] == ["entity_p"] and review.count() == 0
    raw.write.parquet(str(tmp_path / "in"))
    batches.link_stream(batches.file_stream(spark, str(tmp_path / "in")), model, files.Config(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/auto")).count() == 1


def test_train_and_predict_finds_planted_entities(spark):
    got = {}
    for r in Q.train_and_predict(spark, DATA).collect():
        got.setdefault(r.predicted_entity_id, set()).add(int(r.profile_id))
    users = {r.user_id for r in Q.read(spark, DATA, "events").select("user_id").distinct().collect()}
    want = {}
    for u in users:
        want.setdefault(u // 2, set()).add(u)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_blocks_beyond_forty_members(spark, tmp_path):
    ids = range(1, 61)
    spark.createDataFrame([(i, 3, "A", 100.0 * i) for i in ids], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, i, "view", 1.0, '{"k": 7}') for i in ids], "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    want = set(itertools.combinations(ids, 2))
    for name in ("blocking_union", "set_similarity", "flagship"):
        assert {(r.a, r.b) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()} == want
    assert Q.blocking_recall(spark, str(tmp_path)).first().recall == 1.0


def test_components_of_all_suppliers(spark, tmp_path):
    keys = range(1, 101)
    spark.createDataFrame([(i,) for i in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.node: r.component for r in Q.components(spark, str(tmp_path)).collect()}
    assert got == {i: (i - 1) % 7 + 1 for i in range(1, 108)}


def _noisy_pairs(spark, rows, salt):
    names = linkage.features_of.NAMES
    of = lambda k: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(k)), F.lit(50)).cast("double")
    made = spark.range(rows).select("id", *[of(k).alias(n) for k, n in enumerate(names)])
    return made.withColumn("label", (F.col(names[0]) + F.col(names[9]) + 0.4 * of(99) > 70).cast("int")).drop("id").repartition(8).cache()


def test_fit_keeps_the_trees_of_sparks_own_validation(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    config = files.Config(trees=60, learning_rate=0.5)
    train, held = (_noisy_pairs(spark, 600, s) for s in (1, 2))
    rows = linkage.weighed(linkage.packed(train, 600).withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True))), config)
    own = GBTClassifier(labelCol="label", weightCol="weight", maxDepth=3, stepSize=0.5, maxIter=60, seed=42, validationIndicatorCol="held", validationTol=0.0)
    want = Pipeline(stages=[VectorAssembler(inputCols=list(linkage.features_of.NAMES), outputCol="features"), own]).fit(rows)
    got = linkage.fit(train, config, held)
    assert 1 < got.stages[-1].getNumTrees == want.stages[-1].getNumTrees < 60
    assert got.stages[-1].treeWeights == want.stages[-1].treeWeights and got.stages[-1].getMaxIter() == 60
    p = lambda m: [r.p for r in linkage.score(m, held.withColumn("k", F.xxhash64(*linkage.features_of.NAMES))).orderBy("k").collect()]
    assert p(got) == pytest.approx(p(want), abs=1e-9)
    files.save_model(got, str(tmp_path / "model"))
    assert p(files.load_model(str(tmp_path / "model"))) == p(got)
    assert linkage.fit(train, config, held.limit(0)).stages[-1].getNumTrees == 60


def test_fit_starts_few_tasks_a_step(spark):
    train, held = (_noisy_pairs(spark, 400, s) for s in (3, 4))
    train.count(), held.count()
    sc, tasks = spark.sparkContext, {}
    for steps in (2, 12):
        sc.setJobGroup(f"fit-{steps}", "fit")
        linkage.fit(train, files.Config(trees=steps, learning_rate=0.01), held)
        info = sc.statusTracker()
        stages = [s for j in info.getJobIdsForGroup(f"fit-{steps}") for s in info.getJobInfo(j).stageIds]
        tasks[steps] = sum(x.numCompletedTasks for s in stages if (x := info.getStageInfo(s)))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < tasks[12] - tasks[2] <= 10 * 12


def test_features_make_sets_once_a_profile(spark):
    """Grams were cut for each pair, and the sets met again for each use."""
    data = linkage.link_profiles(files.drop_labels(Q.raw_events(spark, DATA)), Q.Scratch(spark))
    built = features.build_features(blocking.candidate_pairs(data.profiles, data.sites), data.profiles, data.sites)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "transform(" not in plan and plan.count("array_intersect") == 12


def test_features_of_missing_values(spark):
    data = linkage.link_profiles(files.drop_labels(Q.raw_events(spark, DATA)), Q.Scratch(spark))
    none = data.profiles.select(*[F.lit(None).cast(t).alias(n) if n in features.USED else F.col(n) for n, t in data.profiles.dtypes])
    row = features.build_features(spark.createDataFrame([("0", "1")], "a string, b string"), none, data.sites.limit(0)).first().asDict()
    same = {n for n in features.NAMES if n.endswith("_jaccard")}
    assert row["last_event_diff_days"] is None
    assert {n for n in features.NAMES if row[n] == 1.0} == same and all(row[n] == 0.0 for n in features.NAMES if n not in same | {"last_event_diff_days"})
