import numpy as np
import pandas as pd
import pytest
from oracle import SF, connect, same

from corvane.llm import topk_search
from corvane.llm.topk_search import Search, Tree, cover_tree, covering, exact_top_k, most_possible, op8_top_k, sortable

SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, top string, query string"


def brute(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is None or i % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(ok) if b != a)
        out += [(i, n, f[3], -f[0]) for n, f in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in exact_top_k(df).collect()), key=repr)


def test_query_matches_sql(spark):
    same(op8_top_k(spark, SF), topk_search.SQL, connect())


@pytest.mark.parametrize("tiles", [(32, 32), (1024, 8192)])
def test_like_brute_force(spark, monkeypatch, tiles):
    for name, value in zip(("LEAST_TILE", "DATA_TILE", "LEAF", "SAMPLE"), (*tiles, 8, 40)):
        monkeypatch.setattr(topk_search, name, value)
    draw = np.random.default_rng(2)
    base = draw.standard_normal((9, 6))
    rows = [(int(i), [float(np.float32(x)) for x in np.round(base[i % 9] + 0.1 * draw.standard_normal(6), 2)]) for i in range(-100, 500)]
    assert got(spark, rows) == brute(rows)


def test_rows_are_dealt_once_and_trees_made_once(monkeypatch):
    """A tile's rows come before its queries, which pass by its tree in chunks, over frames cut anywhere."""
    monkeypatch.setattr(topk_search, "QUERY_CHUNK", 7)
    made, real = [], topk_search.cover_tree
    monkeypatch.setattr(topk_search, "cover_tree", lambda points, rows: made.append(len(rows)) or real(points, rows))
    draw = np.random.default_rng(6)
    v = np.round(draw.standard_normal((120, 4)), 2)
    frame = pd.DataFrame({"row": range(120), "id": range(120), "nameless": False, "embedding": list(v), "floor": -np.inf, "asks": False, "dt": np.arange(120) // 40})
    asked = pd.concat([frame.iloc[:30].assign(asks=True, dt=t) for t in range(3)])
    rows = pd.concat([frame, asked]).sort_values(["dt", "asks"], kind="stable")
    for size in (1, 9, 500):
        made.clear()
        out = pd.concat(topk_search._answers(5)(iter([rows.iloc[a : a + size] for a in range(0, len(rows), size)])))
        best = out.sort_values(["query_row", "score", "id"], ascending=[True, False, True]).groupby("query_row").head(5)
        scores = topk_search.scaled(v[:30]) @ topk_search.scaled(v).T
        for x, own in best.groupby("query_row"):
            want = sorted((y for y in range(120) if y != x), key=lambda y: (-scores[x, y], y))[:5]
            assert own["id"].tolist() == want
        assert made.count(40) == 3 and len(best) == 150 and max(n for n in made if n != 40) <= max(7 + size, 30)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (50, []), (100, [0.0, 0.0, 3.0]), (150, None), (200, [nan, 1.0]), (250, [inf]), (300, [None, 1.0]), (1, [1.0, -0.5]), (None, [2.0, 2.0]), (-50, [0.001])]
    assert got(spark, rows) == brute(rows)


def test_ids_beyond_doubles_beside_null_ones(spark):
    big = (1 << 60) // 50 * 50
    rows = [(big, [1.0]), (big + 1, [2.0]), (big + 2, [2.0]), (None, [2.0]), (big + 50, [1.0]), (None, [3.0])]
    assert got(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert got(spark, [(0, [1.0]), (2, [2.0])]) == [(0, 1, 2, 256 * 512)]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(1e6 + i)), float(np.float32(7e5 - 3 * i))]) for i in range(0, 120, 10)]
    assert got(spark, rows) == brute(rows)


def test_runs_of_tiles():
    assert topk_search._runs([]) == []
    assert topk_search._runs([(4, 2), (0, 1), (0, 1), (1, 1), (7, 3)]) == [(0, 1), (4, 5), (7, 9)]


def test_scores_beyond_longs_keep_their_order(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [2e30, 1.0]), (3, [-1e30, 0.0]), (4, [-2e30, 0.0])]
    out = got(spark, rows)
    assert [(r[1], r[2]) for r in out] == [(1, 2), (2, 1), (3, 3), (4, 4)]
    assert [r[3] for r in out] == [2**63 - 1, 2**63 - 1, -(2**63), -(2**63)]
    numbers = [-(10**82), -1, 0, 1, 10**82]
    assert [sortable(x) for x in numbers] == sorted(map(sortable, numbers))


def test_trees_cover_and_bounds_hold():
    draw = np.random.default_rng(4)
    for offset in (0, 90):
        points = np.round(draw.standard_normal((700, 5)) * 50 + offset)
        points[:300] = points[0]
        points[-1] = 0
        leaves = []

        def walk(node: Tree):
            if not node.children:
                leaves.append(node.rows)
            elif node.bounds is not None:
                assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
                for i, c in enumerate(node.children):
                    assert (np.linalg.norm(points[c.rows] - node.bounds.centre[i], axis=1) <= node.bounds.radius[i] + 1e-6).all()
                    walk(c)

        walk(cover_tree(points, np.arange(700)))
        for a in leaves[:12]:
            for b in leaves[-12:]:
                assert (points[a] @ points[b].T).max() <= most_possible(covering(points[a]), covering(points[b]))[0, 0] + 1e-6


def test_search_is_exact_and_prunes_clusters():
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((20, 16))
    for spread, share in ((0.05, 0.2), (3.0, 1.0)):
        points = centres[draw.integers(0, 20, 4000)] + spread * draw.standard_normal((4000, 16))
        points = np.floor(256 * points / np.linalg.norm(points, axis=1, keepdims=True))
        q, d, ids = points[:200], points[200:], draw.permutation(3800)
        scores = q @ d.T
        for floor in (np.sort(scores, axis=1)[:, -5], np.full(200, -np.inf)):
            search = Search(q, np.arange(200) + 10_000, floor, d, np.arange(3800), ids, 5)
            i, j, s = search.run()
            for x in range(200):
                want = sorted(range(3800), key=lambda y: (-scores[x, y], ids[y]))[:5]
                own = np.flatnonzero(i == x)
                assert sorted(j[own]) == sorted(want) and sorted(s[y] for y in own) == sorted(scores[x, want])
            if np.isfinite(floor).all():
                assert search.products <= share * 200 * 3800
