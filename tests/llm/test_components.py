import random

from corvane.llm.components import components


def roots(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {x: find(x) for x in top if find(x) != x}


def test_like_union_find(spark):
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(200, 260)]  # a chain
    pairs += [(1000, 1000 + draw.randrange(1, 400)) for _ in range(500)]  # a hub, with edges that repeat
    pairs += [(draw.randrange(-300, 200), draw.randrange(-300, 200)) for _ in range(300)] + [(7, 7), (-(1 << 62), 1 << 62)]
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == roots(pairs) and len(got) == len(roots(pairs))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
