from types import SimpleNamespace

import pytest

from codeloom import settings


def fake_session(master):
    conf = {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master)
    )


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        settings.shared_folder(fake_session(master))


def test_one_machine_takes_a_folder_once():
    session = fake_session("local[2]")
    assert settings.shared_folder(session) == settings.shared_folder(session)


def test_scope_removes_its_tables(spark):
    with settings.scratch_scope(spark):
        table = settings.materialize(spark.range(3), "scoped")
        files = table.inputFiles()
        assert table.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
