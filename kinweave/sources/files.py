"""Files in and out: event tables, reports, models and the experiment registry."""

from __future__ import annotations

import datetime
import json
import os
from dataclasses import asdict, dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.session import _fs_path

S, A = T.StringType(), T.ArrayType(T.StringType())
#: The raw event; labelled data has entity_id, and may have entity_type, besides.
EVENT = T.StructType(
    [T.StructField("created_at", T.TimestampType())]
    + [T.StructField(n, S) for n in ("first_name", "last_name", "email", "phone", "birthday", "sex")]
    + [T.StructField("non_processing_features", A), T.StructField("realtime_features", S), T.StructField("fs_features", A), T.StructField("profile_id", S)]
)


@dataclass(frozen=True)
class Config:
    """Parameters of a run; an experiment's report carries its own."""

    block_cap: int = 800
    match_threshold: float = 0.99
    cluster_threshold: float = 0.95
    cluster_method: str = "complete"
    confidence_threshold: float = 0.99
    negative_ratio: int = 8
    #: As many steps as the reference's 2,500 of 0.03 make: a pure leaf passes the thresholds after about 125 trees. Validation ends training earlier.
    trees: int = 750
    max_depth: int = 3
    learning_rate: float = 0.1
    positive_weight: float = 10.0
    seed: int = 42
    active_experiment: str | None = None


def load_config(path: str) -> Config:
    """JSON, or flat `key: value` lines; unknown keys are ignored."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        found = json.loads(text)
    except ValueError:
        found = {}
        for line in text.splitlines():
            key, colon, value = line.split("#")[0].partition(":")
            if colon and value.strip():
                try:
                    found[key.strip()] = json.loads(value.strip())
                except ValueError:
                    found[key.strip()] = value.strip().strip("'\"")
    return replace(Config(), **{k: v for k, v in found.items() if k in Config.__dataclass_fields__})


def save_config(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(config), f, indent=2)


def active_experiment(config: Config) -> tuple[Config, str | None]:
    """The active report's own config and model path; this config and None where there is none."""
    if not config.active_experiment or not os.path.exists(config.active_experiment):
        return config, None
    with open(config.active_experiment, encoding="utf-8") as f:
        report = json.load(f)
    own = {k: v for k, v in report.get("config", {}).items() if k in Config.__dataclass_fields__}
    model = report.get("model_path")
    return replace(config, **own), model if model and os.path.exists(model) else None


def set_active_experiment(config_path: str, report_path: str) -> Config:
    if not os.path.exists(report_path):
        raise FileNotFoundError(report_path)
    config = replace(load_config(config_path), active_experiment=os.path.abspath(report_path))
    save_config(config, config_path)
    return config


def latest_parquet(spark: SparkSession, directory: str) -> str | None:
    """The parquet file modified last, in any file system Spark knows; None if there is none."""
    fs, target = _fs_path(spark, directory)
    if not fs.exists(target):
        return None
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(target) if s.getPath().getName().endswith(".parquet")]
    return max(found)[1] if found else None


def read_events(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    schema = T.StructType([*EVENT.fields, T.StructField("entity_id", S)]) if labelled else EVENT
    return spark.read.schema(schema).parquet(path)


def read_event_json(spark: SparkSession, path: str) -> DataFrame:
    """Records as a JSON array or as lines."""
    return spark.read.schema(EVENT).option("multiLine", True).json(path)


def drop_labels(df: DataFrame) -> DataFrame:
    """Without entity_id and entity_type, if entity_id is there."""
    return df.drop("entity_id", "entity_type") if "entity_id" in df.columns else df


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str, ensure_ascii=False)


def report_of(df: DataFrame) -> dict:
    """A one-row result as plain Python values."""
    row = df.first()
    return row.asDict(True) if row else {}


def preview(df: DataFrame, rows: int = 5) -> dict:
    return {"rows": df.count(), "columns": df.columns, "head": [r.asDict(True) for r in df.limit(rows).collect()]}


def stamp(prefix: str, now: datetime.datetime | None = None) -> str:
    return f"{prefix}_{(now or datetime.datetime.now()).strftime('%Y-%m-%d_%H-%M-%S')}"


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
