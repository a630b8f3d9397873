import random

from evalframe.llm.common import components


def joined(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    star = [(7000, 7001 + i) for i in range(400)]
    inner = [(8000 - i, 8400) for i in range(300)]
    chain = [(9000 + i, 9001 + i) for i in range(120)]
    zigzag = [(9600 + (i * 37) % 101, 9600 + ((i + 1) * 37) % 101) for i in range(100)]
    loose = [(rnd.randrange(-500, 500), rnd.randrange(-500, 500)) for _ in range(420)]
    pairs = [(a, b) for a, b in star + inner + chain + zigzag + loose if a != b]
    pairs += pairs[:50] + [(b, a) for a, b in pairs[50:90]]
    df = spark.createDataFrame([*pairs, (5, 5)], "a long, b long").repartition(5)
    got = components(df).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == joined(pairs)


def test_no_edges(spark):
    df = spark.createDataFrame([(1, 1)], "a long, b long")
    assert components(df).count() == 0 and components(df.limit(0)).count() == 0
