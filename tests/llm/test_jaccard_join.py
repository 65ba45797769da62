import random
import re

import pytest
from pyspark.sql import functions as F
from oracle import SF, connect, same as same_rows

from corvane.llm import jaccard_join
from corvane.llm.jaccard_join import drop_near_duplicates, jaccard_classes
from corvane.llm.shingles import shingle_set, word_hashes


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[top(a)] = min(least.get(top(a), i), i)
    return [(i, len(sets[a]), links[a], least.get(top(a)), top(a)) for a, (i, _) in enumerate(rows)]


def corpus(n=160, seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.6:
            w = draw.choice(rows[-40:])[1].split(" ")
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
        else:
            w = [draw.choice(vocabulary) for _ in range(draw.choice([2, 4, 5, 6, 20, 60, 120]))] + passage * (draw.random() < 0.3)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("tile", "lists"), [(300, 3), (1 << 20, 48)])
def test_like_brute_force(spark, monkeypatch, tile, lists):
    monkeypatch.setattr(jaccard_join, "LIST_GROUPS", lists)
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", tile)
    monkeypatch.setattr(jaccard_join, "BIN_SHINGLES", 4 * tile)
    rows = corpus()
    got = sorted(tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute(rows)
    assert got == [w[:4] for w in want]
    assert sum(w[2] > 0 for w in want) > 40


def test_long_lists_and_a_large_component(spark):
    draw = random.Random(9)
    passage, rows = [f"p{k}" for k in range(6)], []
    for i in range(70):  # a passage in more groups than LIST_GROUPS, in texts with little else, of which few link
        rows.append((i, " ".join(passage + [f"x{i}w{k}" for k in range(5)])))
    base = [f"b{k}" for k in range(80)]
    for i in range(70, 300):  # a chain of near copies of one text
        base[draw.randrange(80)] = f"c{i}"
        rows.append((i, " ".join(base)))
    got = sorted(tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [w[:4] for w in brute(rows)]
    assert got == want
    assert jaccard_join.LIST_GROUPS < 70 and sum(w[3] == 70 for w in want) == 230


def test_colliding_keys_change_nothing(spark, monkeypatch, odd_docs):
    rows = corpus(80)
    monkeypatch.setattr(jaccard_join, "_key", lambda *columns: F.lit(7).cast("long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(tuple(r) for r in jaccard_classes(docs).collect()) == [w[:4] for w in want]
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == sorted({w[3] if w[1] else w[0] for w in want})
    given = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in jaccard_classes(odd_docs).collect()), key=repr) == sorted((w[:4] for w in brute(given)), key=repr)


def test_sets_of_equal_first_digests_stay_apart(spark, monkeypatch):
    """With the first 64 bits of all sets' digests equal, classes and what is kept are those of brute force."""
    real = jaccard_join._digest
    monkeypatch.setattr(jaccard_join, "_digest", lambda x, seed: 5 if seed == 1 else real(x, seed))
    base, other = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "tail"])), (3, " ".join(other)), (4, " ".join([*other, "end"])), (5, "something else of five words")]
    for tile in (50, 1 << 20):
        monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", tile)
        for given in (rows, corpus(80)):
            docs, want = spark.createDataFrame(given, "doc_id long, text string"), brute(given)
            assert sorted(tuple(r) for r in jaccard_classes(docs).collect()) == [w[:4] for w in want]
            assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == sorted({w[3] if w[1] else w[0] for w in want})


def verified(spark, monkeypatch, rows):
    """Result rows and the table of compared pairs."""
    kept = []
    real = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, what: kept.append((what, x := real(df, what))) or x)
    got = sorted(tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    return got, dict(kept)["verified"][0]


def test_only_pairs_that_pass_the_filter_are_compared(spark, monkeypatch):
    """A shingle run in many texts makes one area of them, of whose pairs few are compared."""
    passage, rows = [f"p{k}" for k in range(7)], []
    for i in range(300):
        own = [f"x{i}w{k}" for k in range(6)] + passage
        rows.append((2 * i, " ".join(own)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join([*own, "more"])))
    for tile in (400, 1 << 20):
        monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", tile)
        got, table = verified(spark, monkeypatch, rows)
        assert got == [w[:4] for w in brute(rows)]
        compared = table.selectExpr("sum(compared)").first()[0]
        assert 100 <= compared < len(rows) * 10


def test_a_shingle_of_very_many_groups_meets_in_no_task(spark, monkeypatch):
    """Postings of a long list are joined with a written table, by a join that Spark splits, and never gathered."""
    rows = [(i, " ".join([f"p{k}" for k in range(8)] + [f"x{i}"])) for i in range(5000)] + [(5000 + i, " ".join(f"y{i}w{k}" for k in range(8))) for i in range(300)]
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "8",
        "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    plans, real = {}, jaccard_join.written

    def watch(df, what):
        out = real(df, what)
        if what == "long-lists":
            df.collect()
            plans[what] = df._jdf.queryExecution().executedPlan().toString()
            plans["rows"] = out[0].count()
        if what == "verified":
            plans["compared"] = out[0].selectExpr("sum(compared)").first()[0]
        return out

    monkeypatch.setattr(jaccard_join, "written", watch)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert all(r.n_links == 0 and r.component_id == r.doc_id for r in jaccard_classes(docs).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plans["rows"] >= 5000 and "SortMergeJoin(skew=true)" in plans["long-lists"] and plans["compared"] == 0


def test_bound_is_reached_exactly(spark):
    # 9 shingles, 8 in common of 10 together: exactly 0.8; with 7 of 9 below it.
    a = "a b c d e f g h i j k l m"
    rows = [(1, a), (2, "x " + a.removesuffix(" m")), (3, "p q r s t u"), (4, "P\tq\x0bR\n\ns  t u"), (5, "p q r s t")]
    got = [tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [w[:4] for w in brute(rows)]
    assert sorted(got)[1][2:] == (1, 1)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in jaccard_classes(odd_docs).collect()), key=repr)
    assert got == sorted((w[:4] for w in brute(rows)), key=repr)
    assert jaccard_classes(no_docs).count() == 0
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    tops = {}
    for (i, t), w in zip(rows, brute(rows)):
        if w[1]:
            tops.setdefault(w[4], []).append(i)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(bool(shingles(t)) for _, t in left) == len(tops)
    assert sum(not shingles(t) for _, t in left) == sum(not shingles(t) for _, t in rows)
    assert drop_near_duplicates(no_docs).count() == 0


def test_hashes_of_parts_equal_hashes_of_the_whole(monkeypatch):
    from corvane.llm import shingles as module

    text = ("Some words and " + "long" * 50 + " ones\n\t") * 40
    whole = word_hashes(text.encode())
    assert len(whole) == len(words(text))
    monkeypatch.setattr(module, "_SHARE", 37)
    assert (word_hashes(text.encode()) == whole).all()
    assert len(shingle_set(text.encode())) == len(shingles(text))


def test_query_matches_sql(spark):
    same_rows(jaccard_join.op4_jaccard_join(spark, SF), jaccard_join.SQL, connect())
