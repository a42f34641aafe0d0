import os
import random

from quaymark.llm.common import connected_components, merged_components, remove_written, written


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7), (300, 299), (300, 299)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 21)}, **{100 + i: 100 for i in range(1, 9)}, 300: 299}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_further_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    df = lambda x: spark.createDataFrame(x, "a long, b long")
    want = {r.node: r.component for r in connected_components(df(links)).collect()}
    for cut in (0, 20, 50):
        rows = merged_components(connected_components(df(links[:cut])), df(links[cut:])).collect()
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_written_tables_can_be_removed(spark):
    df = written(spark.range(3).toDF("n"), "kept")
    path = spark._quaymark_written[-1]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    assert remove_written(spark) >= 1 and not os.path.exists(path.removeprefix("file://")) and remove_written(spark) == 0
