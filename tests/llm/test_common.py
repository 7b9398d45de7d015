import random

from attesta.llm.common import connected_components


def test_components_against_union(spark):
    rng = random.Random(2)
    path = list(range(40))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7), (500, 501), (501, 500), (500, 501)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {(x, find(x)) for x in list(root)}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
