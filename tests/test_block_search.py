"""Pivot bounds change what is compared, never what is found."""

import numpy as np
import pytest

from codeloom.operators import block_search
from codeloom.operators.block_search import BlockSearch


def table(spark, rows, name):
    return spark.createDataFrame([(g, i, [float(x) for x in v]) for g, i, v in rows], f"code string, {name} bigint, vector array<double>").repartition(3)


def expected(queries, candidates, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    out = {}
    for g, i, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(w)), 12) + 0.0, j) for h, j, w in candidates if h == g)[:k]
        out.update({(g, i, n + 1): j for n, (_, j) in enumerate(scored)})
    return out


def found(search, queries, k):
    return {(r.code, r.row_id, r.rank): r.cand_id for r in search.top_k(queries, k).collect()}


@pytest.mark.parametrize(("block_rows", "max_pivots"), [(4096, 32), (10, 32), (10, 3), (25, 1)])
def test_clusters_ties_zeros_and_unequal_groups(spark, block_rows, max_pivots):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    candidates = [("A", n, centres[n % 6] + 0.05 * rng.normal(size=5)) for n in range(150)]
    # Copies of one vector in a third of the group, zero vectors, a group of one, a group nobody asks for.
    candidates += [("A", 200 + n, centres[0]) for n in range(75)] + [("A", 300, np.zeros(5)), ("A", 301, np.zeros(5)), ("B", 1, centres[1]), ("C", 1, centres[2])]
    queries = [("A", n, centres[n % 6] + 0.2 * rng.normal(size=5)) for n in range(40)] + [("A", 50, np.zeros(5)), ("B", 1, centres[2]), ("D", 1, centres[0])]
    search = BlockSearch(table(spark, candidates, "cand_id"), ["code"], block_rows, max_pivots)
    for k in (1, 4, 100):
        assert found(search, table(spark, queries, "row_id"), k) == expected(queries, candidates, k)


def test_without_room_for_pivots(spark, monkeypatch):
    monkeypatch.setattr(block_search, "MAX_BROADCAST_BYTES", 0)
    rng = np.random.default_rng(2)
    candidates = [("A", n, rng.normal(size=4)) for n in range(60)]
    queries = [("A", n, rng.normal(size=4)) for n in range(10)]
    search = BlockSearch(table(spark, candidates, "cand_id"), ["code"], 7)
    assert found(search, table(spark, queries, "row_id"), 3) == expected(queries, candidates, 3)


def test_empty_tables(spark):
    some = table(spark, [("A", 1, [1.0, 0.0])], "cand_id")
    queries = some.withColumnRenamed("cand_id", "row_id")
    assert found(BlockSearch(some.limit(0), ["code"]), queries, 2) == {}
    assert found(BlockSearch(some, ["code"]), queries.limit(0), 2) == {}


def test_visits_grow_less_than_candidates_on_clustered_data(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 12))
    queries = [("A", n, centres[n % 16] + 0.02 * rng.normal(size=12)) for n in range(64)]
    asked = table(spark, queries, "row_id")
    shares = {}
    for n in (400, 1600):
        candidates = [("A", i, centres[i % 16] + 0.02 * rng.normal(size=12)) for i in range(n)]
        search = BlockSearch(table(spark, candidates, "cand_id"), ["code"], 50, 32)
        blocks = search.dealt.select("pivot", "part").distinct().count()
        near = search._visit(search.visits(asked, True), 2)
        reached = block_search._first(near, ["code"], 2).where("rank = 2").selectExpr("code", "row_id", "score AS reached")
        others = search.visits(asked.join(reached, ["code", "row_id"], "left"), False).count()
        visits = search.visits(asked, True).count() + others
        shares[n] = visits / (blocks * len(queries))
        assert found(search, asked, 2) == expected(queries, candidates, 2)
    assert shares[1600] < 0.5 and shares[1600] <= shares[400]
