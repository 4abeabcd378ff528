"""The registry without the optional folder of training-text operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import sys

class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "basecov.llm" or name.startswith("basecov.llm."):
            raise ModuleNotFoundError(name, name=name)

import importlib.util
import basecov
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("basecov.llm") else real(name, package)
sys.meta_path.insert(0, Hide())

import __spark_entry__ as registry
from basecov.queries import QUERIES

assert set(registry.queries()) == set(QUERIES) == set(registry.oracle_sql()), set(registry.queries()) ^ set(QUERIES)
assert not any(n.startswith("basecov.llm") for n in sys.modules) and "corpus_pipeline" not in sys.modules

from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert registry.entry(spark).columns[:3] == ["chrom", "start_pos", "length"]
spark.stop()
"""


def test_entry_works_without_the_training_text_operators():
    done = subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
