import random

import pytest

from bibspark.operators import ordered as O


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_against_plain_python(spark, parts):
    r = random.Random(parts)
    rows = [(i, r.choice("aaaab"), r.choice("xxyz"), r.randrange(100)) for i in range(200)] + [(200, None, "x", 1), (201, None, "x", 2)]
    d = spark.createDataFrame(rows, "i long, g string, k string, v long").repartition(3)
    rank, run, seen, last, low, before = {}, {}, {}, {}, {}, {}
    for i, g, k, v in rows:
        seen[g] = seen.get(g, 0) + 1
        rank[i] = seen[g]
        n, prev = last.get(g, (0, None))
        last[g] = (n + (prev != k), k)
        run[i] = last[g][0]
        before[i] = low.get(g)
        low[g] = min(v, low.get(g, v))
    assert {x["i"]: x["n"] for x in O.rank(d, ["g"], ["i"], "n", parts).collect()} == rank
    assert {x["i"]: x["n"] for x in O.runs(d, ["g"], ["i"], "k", "n", parts).collect()} == run
    assert {x["i"]: x["n"] for x in O.earlier_min(O.placed(d, ["g"], ["i"], parts), "g", "i", "v", "n").collect()} == before
    assert O.rank(d.limit(0), ["g"], ["i"], "n").count() == 0
