"""Result folders and the metrics file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pellucid.operators import evaluation

FINAL = "result_id string, image_path string, is_success boolean, reasoning string, finally_result int, gt_label int, dataset_name string"


def final_output(folder: str) -> str:
    """The folder of final results: the given one if it has that name, else the one below it."""
    folder = folder.rstrip("/")
    return folder if folder.rsplit("/", 1)[-1] == "final_output" else f"{folder}/final_output"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a folder of JSON files or lines; none if there is no such folder."""
    path = final_output(folder)
    if not exists(spark, path):
        return spark.createDataFrame([], FINAL)
    return spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").schema(FINAL).json(path)


def write(results: DataFrame, folder: str) -> None:
    """Appends results as JSON lines; a job's files appear together when it commits."""
    results.write.mode("append").json(final_output(folder))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Results that write() made."""
    path = final_output(folder)
    return spark.read.schema(FINAL).json(path) if exists(spark, path) else spark.createDataFrame([], FINAL)


def write_metrics(results: DataFrame, folder: str) -> DataFrame:
    """One row of metrics as CSV beside the final results; no file without valid labels."""
    m = evaluation.metrics(results)
    if not m.isEmpty():
        m.coalesce(1).write.mode("overwrite").option("header", True).csv(final_output(folder).rsplit("/", 1)[0] + "/prediction_metrics.csv")
    return m
