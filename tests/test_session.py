"""Tables that cut the lineage."""

from pathlib import Path
from urllib.parse import urlparse

from quire.session import materialize, shared_dir, ship


def test_materialize(spark):
    before = {p.name for p in Path(urlparse(shared_dir(spark)).path).glob("quire-probe-*")}
    made = materialize(spark.range(5), "probe")
    assert sorted(r[0] for r in made.collect()) == [0, 1, 2, 3, 4]
    assert len({p.name for p in Path(urlparse(shared_dir(spark)).path).glob("quire-probe-*")} - before) == 1


def test_ship_once(spark):
    ship(spark)
    ship(spark)
    assert spark.sparkContext._quire_shipped


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context))
