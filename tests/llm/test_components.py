from __future__ import annotations

import random

import pytest

from cohortwise.llm.components import components


def brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_like_brute_force(spark, kind):
    rng = random.Random(kind)
    if kind == "random":
        edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(60)]
    elif kind == "path":
        order = rng.sample(range(200), 200)
        edges = list(zip(order, order[1:]))
    elif kind == "star":
        edges = [(50, i) for i in range(300)] + [(-1, 299), (-1, 299)]
    else:
        edges = []
    want = {n: c for n, c in brute(edges).items() if any(a != b and n in (a, b) for a, b in edges)}
    frame = spark.createDataFrame([*edges, (None, 5), (7, None), (9, 9)], "x long, y long")
    got = [tuple(r) for r in components(frame).collect()]
    assert len(got) == len(set(got)) and dict(got) == want
