import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from basecov.operators.vectors import Groups


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("basecov-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_reads(spark):
    def make(rows):
        return spark.createDataFrame(rows, "sample_id INT, chrom STRING, start_pos INT, end_pos INT")

    return make


@pytest.fixture(scope="session")
def make_exons(spark, tmp_path_factory):
    """Exons as a file, so that their size is known."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("exons") / "exons")
        schema = "gene_id STRING, exon_id STRING, chrom STRING, start_pos INT, end_pos INT"
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def two_by_two():
    return Groups(case=(1, 2), control=(3, 4))
