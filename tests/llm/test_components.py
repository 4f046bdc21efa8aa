"""Components of few edges over very many partitions: right, and without a file for each partition in each round."""

import random
from pathlib import Path

from colloquy.llm.common import shared_dir
from colloquy.llm.components import components


def test_rounds_over_few_edges_leave_few_files(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    files = lambda: len([f for f in Path(shared_dir(spark).removeprefix("file:")).rglob("part-*")])
    was, before = spark.conf.get("spark.sql.shuffle.partitions"), files()
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set(off, "false")
    try:
        found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset(off)
    assert found == label
    assert 60 <= files() - before <= 60 + 3 * 12
