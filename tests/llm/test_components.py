"""Components of links that come out differently each time they are made."""

import random

import pyarrow as pa
import pytest

from korvid.llm.components import connected_components


def test_links_are_made_once(spark):
    def star(batches):
        import os

        for batch in batches:
            root = int.from_bytes(os.urandom(2), "little") % 40
            others = [x for x in range(40) if x != root]
            yield pa.record_batch([pa.array(others, pa.int64()), pa.array([root] * 39, pa.int64())], names=["src", "dst"])

    for _ in range(3):
        links = spark.range(1).mapInArrow(star, "src long, dst long")
        assert {tuple(r) for r in connected_components(links).collect()} == {(x, 0) for x in range(40)}


def test_chains_trees_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(i, rng.randrange(200, i)) for i in range(201, 260)] + [(5, 5), (7, 3), (3, 7), (3, 7)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 200 for i in range(200, 260)}, 3: 3, 7: 3}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from korvid.llm.common import set_checkpoint_dir

    made = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    session = lambda folder: SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        set_checkpoint_dir(session(None))
    set_checkpoint_dir(session("hdfs://shared"))
    assert made == ["hdfs://shared"]


def test_spent_checkpoints_are_deleted(spark):
    import glob
    from urllib.parse import urlparse

    from korvid.llm.common import checkpoint, forget

    df = checkpoint(spark.range(10))
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    before = set(glob.glob(f"{folder}/rdd-*"))
    forget(df)
    assert len(before - set(glob.glob(f"{folder}/rdd-*"))) == 1
    forget(spark.range(3))  # no checkpoint: nothing happens
