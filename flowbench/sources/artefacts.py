"""Reading trees of saved run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the saved records, as Spark type texts.
_COUNTS = "map<string,bigint>"

RUN_INFO = (
    "created_at string, mode string, split_id string, source_training_split_id string, dataset_id string, "
    "feature_set_id string, model_id string, model_name string, model_path string, seed bigint, train_row_cap bigint, "
    "feature_columns array<string>, training_seconds double, evaluation_seconds double"
)
METRICS = (
    "accuracy double, balanced_accuracy double, precision double, recall double, f1 double, f1_macro double, "
    f"f1_weighted double, confusion_matrix array<array<bigint>>, support {_COUNTS}, predicted_distribution {_COUNTS}, "
    f"training_split_id string, training_label_counts {_COUNTS}, training_sample_label_counts {_COUNTS}, "
    f"evaluation_label_counts {_COUNTS}, feature_columns array<string>, full_training_rows bigint, training_rows bigint, "
    "training_sample_rows bigint, train_row_cap bigint, evaluation_rows bigint, evaluation_seconds double, epochs bigint, "
    "batch_size bigint, learning_rate double, threshold double, threshold_tuned boolean, use_class_weight boolean, "
    "architecture map<string,string>, params map<string,string>"
)
TRAINING_SUMMARY = (
    f"split_id string, training_label_counts {_COUNTS}, sampled_label_counts {_COUNTS}, "
    f"training_sample_label_counts {_COUNTS}, label_counts {_COUNTS}, feature_columns array<string>, "
    "full_training_rows bigint, training_rows bigint, sampled_training_rows bigint, training_sample_rows bigint, "
    "train_row_cap bigint, epochs bigint, batch_size bigint, learning_rate double, threshold double, "
    "threshold_tuned boolean, use_class_weight boolean, architecture map<string,string>, params map<string,string>"
)
SPLIT_METADATA = (
    "split_id string, dataset_id string, split_method struct<type:string>, train_rows bigint, test_rows bigint, "
    f"train_label_distribution {_COUNTS}, test_label_distribution {_COUNTS}"
)

_FILES = {"run_info.json": RUN_INFO, "metrics.json": METRICS, "training_summary.json": TRAINING_SUMMARY,
          "metadata.json": SPLIT_METADATA}

# Tasks that write record files, for each core.
TASKS_A_CORE = 4


def write_records(records: DataFrame, root: str, run: str = "run") -> None:
    """One JSON file per row below ``root``, in a folder named after the row's run; executors write them.

    Making a file takes far longer than its row, so the rows are dealt out by run over all cores, however few files they were read from.
    """
    body = F.to_json(F.struct(*[c for c in records.columns if c != run])).alias("value")
    tasks = TASKS_A_CORE * records.sparkSession.sparkContext.defaultParallelism
    records.select(body, F.col(run).alias("run")).repartition(tasks, "run").write.partitionBy("run").text(root)


def read_records(spark: SparkSession, root: str, file_name: str, pattern: str | None = None) -> DataFrame:
    """All files of one kind below a folder, one row per file, with the name of the folder that holds it.

    The schema is fixed, so a field that some runs lack is null there. ``pattern`` finds the files if they are not called
    ``file_name``, such as those of ``write_records`` (``part-*``).
    """
    records = (
        spark.read.schema(_FILES[file_name])
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern or file_name)
        .json(root)
    )
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return records.withColumn("run", F.regexp_replace(F.url_decode(folder), "^run=", ""))
