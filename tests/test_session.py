import pytest

from basecov import session


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master):
        self.conf, self.sparkContext = _Conf(), _Context(master)


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_temporary_folder_serves_one_process(master):
    spark = _Session(master)
    assert session.scratch_path(spark, "x").startswith(spark.sparkContext.folder)


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "yarn", "k8s://host", "spark://host:7077"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Session(master))


def test_the_named_folder_is_used(spark):
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
