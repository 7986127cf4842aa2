"""Balanced posting lists against a full scan."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import posting_lists as P
from fieldpulse.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, entry string"


def brute(rows, k, asked):
    """{query: [(id, score)]} of usable (id, vector) rows."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero([asked(v) for v in ids.tolist()]):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r)
    assert all([r["rank"] for r in rs] == list(range(1, len(rs) + 1)) for rs in out.values())
    return {q: [(r.vec_id, r.score) for r in rs] for q, rs in out.items()}


def recall(got, want):
    return sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute(rows, 20, lambda v: v % 20 == 0)
    got = by_query(queries.op12_posting_lists(spark, f"/root/testdata/{sf}").collect())
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.9
    x = {r.vec_id: np.array(r.embedding) for r in rows}
    for q, hits in got.items():
        assert np.allclose([s for _, s in hits], [x[q] @ x[v] for v, _ in hits], rtol=0, atol=1e-12)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * (1 + i % 7)).tolist()) for i in range(400)]                 # norms differ
    hot = rng.normal(size=6).tolist()
    rows += [(1000 + i, hot) for i in range(200)]                                                 # a third are copies
    rows += [(2000 + i, [x + 1e-6 * i for x in hot]) for i in range(60)]                          # and nearly so
    no_part = [(3000, None), (3020, [0.0] * 6), (3040, [1.0, None, 0, 0, 0, 0]), (3060, [float("nan")] * 6),
               (3080, [float("inf"), 1, 1, 1, 1, 1]), (3100, [1.0] * 5), (3120, []), (None, [1.0] * 6)]
    return rows, no_part


def frame(spark, rows):
    vectors = [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, None, "s", "e") for i, v in vectors], SCHEMA)


def test_odd_rows_and_copies(spark, monkeypatch):
    rows, no_part = odd_vectors()
    df = frame(spark, rows + no_part + rows[:3])                                                  # repeated rows too
    want = brute(rows, 20, lambda v: v % 20 == 0)
    monkeypatch.setattr(P, "PAGE", 16)                                                            # lists of several pages
    monkeypatch.setattr(P, "QBLOCK", 4)
    got = by_query(P.nearest(spark, df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.9
    copies = [q for q in want if 1000 <= q < 1200]
    for q in copies:                                                                              # ties: the smallest ids
        top = [v for v, s in want[q]]
        assert [v for v, _ in got[q]] == top


def test_all_lists_give_the_full_scan(spark, monkeypatch):
    rows, _ = odd_vectors()
    monkeypatch.setattr(P, "TARGET", 1.0)
    got = by_query(P.nearest(spark, frame(spark, rows), F.lit(True), 5, n_lists=1).collect())
    want = brute(rows, 5, lambda v: True)
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: [v for v, _ in h] for q, h in want.items()}


def test_fewer_candidates_and_none(spark):
    rows = [(i, [float(i + 1), 1.0, -float(i)]) for i in range(0, 120, 20)]
    got = by_query(P.nearest(spark, frame(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    assert {q: {v for v, _ in h} for q, h in got.items()} == {i: {j for j, _ in rows} - {i} for i, _ in rows}
    assert P.nearest(spark, frame(spark, rows[:1]), F.lit(True), 20).count() == 0
    assert P.nearest(spark, frame(spark, []), F.lit(True), 20).count() == 0
    assert P.nearest(spark, frame(spark, [(20, None)]), F.lit(True), 20).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    lists = P.Lists(x, 200, float(np.sqrt((x * x).sum(1)).max()), 3000)
    q = lists.lifted_queries(rng.normal(size=(100, 8)))
    ids, d2 = lists.nearest(q, 64)
    full = P._squared(q.astype(float), lists.centres.astype(float))
    assert np.allclose(np.take_along_axis(full, ids.astype(np.int64), 1), d2, atol=1e-3)
    assert (np.sort(full, 1)[:, 0] >= d2[:, 0] - 1e-3).mean() >= 0.95
    got, keep = lists.assigned(lists.lifted(x))
    assert keep[:, 0].all() and 1.05 < keep.sum(1).mean() <= P.REPLICAS and keep.sum(1).max() <= P.REPLICAS
    sizes = np.bincount(got[keep], minlength=200)
    assert sizes.max() < 6 * sizes.mean()
