import numpy as np
import pytest
from oracle import SF, connect, same as same_rows

from corvane.llm import embedding_dedup
from corvane.llm.embedding_dedup import embedding_classes

SCHEMA = "vec_id long, embedding array<float>, label int, node string, list string, `root` string"


def brute(rows, cosine):
    def ok(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if ok(rows[a]) and ok(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    parent[top(a)] = top(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[top(a)] = min(least.get(top(a), rows[a][0]), rows[a][0])
    return sorted(((r[0], links[a], least.get(top(a)), r[0] == least.get(top(a))) for a, r in enumerate(rows)), key=repr)


def same(spark, rows, cosine=0.98):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in embedding_classes(df, cosine).collect()), key=repr)
    assert got == brute(rows, cosine)


@pytest.mark.parametrize("tile", [16, 2048])
def test_like_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 25)
    draw = np.random.default_rng(3)
    base = draw.standard_normal((12, 16))
    rows = []
    for i in range(260):
        v = base[i % 12] + draw.standard_normal(16) * draw.choice([0.02, 0.12, 0.2, 1.0])
        rows.append((1000 - i, [float(np.float32(x)) for x in v], int(i % 12 % 2)))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(7)] + [(3000, rows[5][1], 9), (3001, rows[5][1], None)]
    same(spark, rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
        (8, [None, 1.0], 1), (None, [0.999, 0.001], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1e30, 1e28], 1), (11, [1e-30, 0.0], 1), (12, [0.0, 1.0], None), (-3, [-1.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = {}
    for r in embedding_classes(df).collect():
        got.setdefault(r.vec_id, (r.n_links, r.component_id, r.kept))
    assert got[1] == (5, 1, True) and got[2] == (5, 1, False) and got[None][:2] == (5, 1) and got[10][1] == 1 and got[11][1] == 1
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 12, -3))


def test_every_link_is_found_among_large_groups(spark, monkeypatch):
    """One group of copies and one of near copies with a third of a label's vectors each, in lists of several tiles, beside many small ones."""
    for name, value in (("LIST_ROWS", 100), ("TILE", 400)):
        monkeypatch.setattr(embedding_dedup, name, value)
    draw = np.random.default_rng(11)
    groups = [np.tile(draw.standard_normal(24), (1000, 1)), draw.standard_normal(24) + 0.11 * draw.standard_normal((1200, 24)), draw.standard_normal((600, 24))]
    groups += [draw.standard_normal(24) + 0.1 * draw.standard_normal((5, 24)) for _ in range(80)]
    points = np.concatenate(groups).astype(np.float32)[draw.permutation(3200)]
    labels = draw.choice([1, 1, 1, 2], len(points))
    want = {}
    for label in (1, 2):
        own = np.flatnonzero(labels == label)
        unit = points[own].astype(float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= 0.98
        np.fill_diagonal(linked, False)
        least = own.copy()
        while True:
            new = np.minimum(least, np.where(linked, least, len(points)).min(1))
            if (new == least).all():
                break
            least = new
        want |= {int(i): (int(n), int(c)) for i, n, c in zip(own, linked.sum(1), least)}
    table = spark.createDataFrame([(i, points[i].tolist(), int(labels[i])) for i in range(len(points))], "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_classes(table).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 500_000


def test_no_list_meets_in_a_join(spark, monkeypatch):
    """Vectors meet the tiles' table where they lie; only tiles are gathered."""
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 50)
    plans, real = {}, embedding_dedup.written

    def watch(df, what):
        out = real(df, what)
        if what == "near-vectors":
            plans[what] = df._jdf.queryExecution().optimizedPlan().toString()
        return out

    monkeypatch.setattr(embedding_dedup, "written", watch)
    draw = np.random.default_rng(1)
    table = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(draw.standard_normal((400, 8)))], "vec_id long, embedding array<float>, label int")
    assert embedding_classes(table).count() == 400
    assert plans["near-vectors"].count("rightHint=(strategy=broadcast)") == 2


def test_lists_ask_each_other_once():
    draw = np.random.default_rng(8)
    points = draw.standard_normal((600, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index = embedding_dedup.fit_index(points, 24)
    own = embedding_dedup.nearest(points, index.centres)
    asks = [set(a) for a in index.probes(points, 0.3)]
    for i in range(600):
        assert own[i] in asks[i]
        for j in np.flatnonzero(np.linalg.norm(points - points[i], axis=1) <= 0.3):
            if own[i] != own[j]:
                assert (own[j] in asks[i]) != (own[i] in asks[j])


def test_empty_table(spark):
    assert embedding_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql(spark):
    same_rows(embedding_dedup.op3_embedding_dedup(spark, SF), embedding_dedup.SQL, connect())
