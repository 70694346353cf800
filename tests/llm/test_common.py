import random

from normlattice.llm import common


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(root)}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(-40, 200)]
    rng.shuffle(chain)
    star = [(1000, 1001 + i) for i in range(300)] + [(1000, 1001)]
    loose = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(140)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + loose]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {k: v for k, v in roots(edges).items() if any(a != b and k in (a, b) for a, b in edges)}
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


def test_no_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_names_and_scratch(spark):
    df = spark.createDataFrame([(1, 2)], "_ONE_id int, x int")
    assert common.fresh(df, "_one_") == "__one_"
    assert common.scratch_dir(spark).startswith("file:")
    again = common.materialise(df, "t")
    assert again.columns == df.columns and again.count() == 1
