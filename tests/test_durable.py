"""Durable tables: where they lie, and that they go."""

from types import SimpleNamespace

import pytest

from tissueflow import durable


def session(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))


def test_folder_of_the_setting_or_of_one_machine():
    """No setting is written: a session without the folder works on one machine, and a cluster says what it needs."""
    assert durable.shared_dir(session("hdfs://x/shared/", "yarn")).startswith("hdfs://x/shared/saved-")
    a, b = (durable.shared_dir(session(None, "local[2]")) for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_dir(session(None, "spark://host:7077"))


def test_saved_and_forgotten(spark):
    t = durable.saved(spark.range(5).withColumnRenamed("id", "x"))
    files = t.inputFiles()
    assert sorted(r.x for r in t.collect()) == [0, 1, 2, 3, 4] and files
    durable.forget(t, spark.range(1))
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(spark._jvm.java.net.URI(files[0]))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
