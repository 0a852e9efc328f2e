"""Shared folders: intermediate tables are written once, found again and forgotten; clusters must name the folder."""

import os
from types import SimpleNamespace

import pytest

from quillon import session


def test_written_and_forgotten(spark):
    df = session.written(spark.range(5), "five")
    assert df.count() == 5
    path = session._folder(spark).removeprefix("file://")
    assert any(x.startswith("five-") for x in os.listdir(path))
    session.forget(spark)
    assert not os.path.exists(path)


@pytest.mark.parametrize(("master", "fits"), [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_a_cluster_names_its_folder(master, fits):
    conf = SimpleNamespace(get=lambda name: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"app-{master}"))
    if fits:
        assert session.shared_dir(fake).startswith("file://")
    else:
        with pytest.raises(ValueError):
            session.shared_dir(fake)
