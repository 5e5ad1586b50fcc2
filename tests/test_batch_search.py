"""A set of queries against all vectors: by blocks and by pairs, against a plain loop."""

import math
import random

import pytest

from tidemark.operators import vectors as V

INF, NAN = math.inf, math.nan


def plain(rows, queries, k):
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    out = {}
    for q, a in queries:
        if q is None or not fine(a):
            continue
        scores = []
        for i, b in rows:
            if i is not None and i != q and fine(b) and len(a) == len(b):
                scores.append((-round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6) + 0.0, i))
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[q, rank] = (i, -s + 0.0)
    return out


@pytest.mark.parametrize("most", [1 << 20, 0], ids=["blocks", "pairs"])
@pytest.mark.parametrize("text", [False, True], ids=["numbers", "texts"])
def test_batch_search(spark, most, text):
    rnd = random.Random(5)
    name = (lambda i: None if i is None else f"ü{i:04}") if text else (lambda i: i)
    rows = [(i, [rnd.choice([-1.0, 0.5, 2.0, 0.25]) for _ in range(4)]) for i in range(120)]
    rows += [(i, [1.0, 2.0, 0.5, 0.25]) for i in range(200, 400)]  # copies: many ties
    rows += [(500, None), (501, []), (502, [0.0] * 4), (503, [1.0, None, 1.0, 1.0]), (504, [NAN, 1.0, 1.0, 1.0]), (505, [INF, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (506, [1.0, 2.0]), (507, [2.0, 1.0]), (3, [1.0] * 4)]
    rnd.shuffle(rows)
    rows = [(name(i), v) for i, v in rows]
    wanted = {name(i) for i in (0, 1, 2, 250, 500, 501, 502, 503, 504, 505, 506)}
    queries = [r for r in rows if r[0] in wanted] + [(None, [1.0] * 4)]
    schema = f"vector_id {'string' if text else 'long'}, embedding array<float>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.query_id, r["rank"]): (r.vector_id, r.score) for r in V.batch_search(df, spark.createDataFrame(queries, schema), 7, most).collect()}
    want = plain(rows, queries, 7)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())
    assert V.batch_search(df.limit(0), df, 7, most).count() == 0 and V.batch_search(df, df.limit(0), 7, most).count() == 0
