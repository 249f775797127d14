"""Intermediate tables go where the session says."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from centwise.storage import shared_dir

SCRIPT = """
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from centwise.storage import cut, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
assert shared_dir(spark) == {folder!r}
assert cut(spark.range(5)).count() == 5
spark.stop()
"""


def test_session_folder_is_used(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = str(tmp_path / "shared")
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=folder)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [n for n in os.listdir(folder) if n.startswith("cut-")]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, master, folder=None):
            self.values = {"spark.master": master} | ({"spark.checkpoint.dir": folder} if folder else {})

        def get(self, key, default=None):
            return self.values.get(key, default)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=Conf(master)))
        assert shared_dir(SimpleNamespace(conf=Conf(master, "hdfs://host/folder/"))) == "hdfs://host/folder"
    assert os.path.isdir(shared_dir(SimpleNamespace(conf=Conf("local[4]"))))
