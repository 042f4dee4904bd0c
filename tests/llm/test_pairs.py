import random

import numpy as np
import pytest

from tidegate.llm import common, jaccard, pq


def gram_set(text, n=3):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    """Component and set size by id."""
    sets = {i: gram_set(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = [" ".join(r.choice(words) for _ in range(30)) for _ in range(4)]
    rows = []
    for _ in range(60):
        rows.append(" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 40, 200]))))
    for _ in range(20):
        rows.append(r.choice(shared) + " " + " ".join(r.choice(words) for _ in range(40)))
    base = [r.choice(words) for _ in range(120)]
    for _ in range(90):  # a large group of near copies, of which some pairs link and some don't
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append(" ".join(t))
    rows += [rows[0].upper(), rows[65] + " ", rows[65]]
    return list(enumerate(rows, 10))


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == brute_force(rows)
    kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
    assert kept == {c for _, c in got.values()}


def test_tiles_and_long_lists(spark, monkeypatch):
    """The same with tiles so small that clusters are cut, and every list a long one."""
    rows = corpus(2)[40:]
    monkeypatch.setattr(jaccard, "TILE_DOCS", 7)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


def test_repeated_rows_leave_one(spark):
    """Rows with one id, equal texts without an id, and columns with clashing names."""
    rows = [
        (1, "a b c d e"), (1, "a b c d e"), (2, "A b  c d e"), (3, None), (3, ""), (4, "x y z w"), (4, "q r s t u"), (5, "k l m n"),
        (None, "k l m n"), (None, "only here twice"), (None, "only here twice"), (None, "Only here TWICE"), (None, None), (None, " "), (6, "lone words stand here"),
    ]
    df = spark.createDataFrame([(*x, k, "c", 0.5, None) for k, x in enumerate(rows)], "doc_id long, text string, row int, component_id string, count double, `print` string")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = [(1, "a b c d e"), (3, None), (4, "q r s t u"), (5, "k l m n"), (6, "lone words stand here"), (None, None), (None, " ")]
    rest = [x for x in kept if x not in want or want.remove(x)]
    assert (not want or want == [(3, None)]) and len(kept) == 8, kept
    assert all(i == 3 or (i is None and t.lower() == "only here twice") for i, t in rest), rest
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Tables as those of some GB of documents: members of clusters, and ids."""
    who = spark.range(150_000).selectExpr("id", "id as root", "array(struct(0 as i, 0 as j, 0 as side)) as places")
    assert jaccard.small(who) is who and jaccard.small(who.select("id")) is not jaccard.small(who.limit(9)) is not who
    docs = spark.range(4000).selectExpr("if(id % 97 = 0, null, cast(id - 700 as int)) as doc_id", "id as bucket", "'x' as `a.b`")
    docs = docs.unionAll(spark.range(3).selectExpr("cast(6 as int)", "id", "'y'"))
    ids = spark.range(-350, 4000, 7).selectExpr("id as doc_id")
    want = [(r.doc_id is not None and r.doc_id >= -350 and r.doc_id % 7 == 0, tuple(r)) for r in docs.collect()]
    for most, cells in ((common.BROADCAST_BYTES, common.ID_CELLS), (0, common.ID_CELLS), (0, 64)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        monkeypatch.setattr(common, "ID_CELLS", cells)
        for inside, got in zip((True, False), common.parted(docs, ids, "doc_id"), strict=True):
            assert got.columns == docs.columns
            assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(r) for k, r in want if k is inside)


def test_components_without_broadcasts(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([*rows, rows[70], (None, rows[3][1])], "doc_id long, text string")
    want = brute_force(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df.where("doc_id is not null")).collect()} == want
    assert sorted(r.doc_id for r in jaccard.one_of_each(df).collect()) == sorted({c for _, c in want.values()})


def test_counting_in_two_stages(spark, monkeypatch):
    from pyspark.sql import functions as F

    bodies = common.texts(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(9)).withColumn("body", F.col("body"))
    one = jaccard.common_cells(bodies)
    monkeypatch.setattr(jaccard, "STAGED", 1)
    assert (jaccard.common_cells(bodies) == one).all()


def test_hubs_are_joined_apart(spark, monkeypatch):
    """A star, a chain and a clique, with and without hubs that are broadcast."""
    r = random.Random(2)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(a, b) for a in range(2000, 2030) for b in range(a)if b >= 2000] + [(399, 1020), (5000, 5000)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    want = {**{k: 0 for k in range(400)}, **{k: 0 for k in range(1000, 1041)}, **{k: 2000 for k in range(2000, 2030)}}
    for hub in (5, 200, 10**6):
        monkeypatch.setattr(common, "HUB_LINKS", hub)
        assert {x.node: x.root for x in common.components(df).collect()} == want


def test_products_equal_set_sizes():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 120)).astype(np.uint64)) for _ in range(80)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = jaccard.overlaps(sets)
    assert (got[~np.eye(80, dtype=bool)] == want[~np.eye(80, dtype=bool)]).all()
    assert (jaccard.overlaps(sets[:30], sets[30:]) == want[:30, 30:]).all()


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(5, 900))
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: int(n * r.uniform(0, 0.08))] = r.integers(0, 2**63, int(n * r.uniform(0, 0.08)) or 1)[:1]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert not jaccard.far_apart(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b))


def test_bounds():
    for n in range(1, 300):
        assert jaccard.prefix_length(n) == n - -(-9 * n // 10) + 1
        for m in range(max(1, n - 40), n + 1):
            t = jaccard.least_overlap(n, m)
            assert 100 * t >= 90 * (n + m - t) and 100 * (t - 1) < 90 * (n + m - t + 1)


def test_odd_rows(odd, nothing):
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for i in (2, 3, 4):
        assert (by[i].n_shingles, by[i].component_id) == (0, i)
    assert by[8].n_shingles == 1 and by[9].component_id == 9 and by[1].component_id == 1
    assert jaccard.join(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0
    assert jaccard.one_of_each(odd).columns == odd.columns


def test_component_search(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(60)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({i for e in edges for i in e})
    at = {i: k for k, i in enumerate(ids)}
    root = common.forest(len(ids), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert got == {i: ids[root[at[i]]] for i in ids if any(i in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_tasks(spark, monkeypatch):
    """A chain, a star and cliques over 211 partitions that stay apart: solved by one task from the
    start, by steps alone, and by one task after some steps."""
    r = random.Random(8)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(a, b) for t in (2000, 3000) for a in range(t, t + 30) for b in range(t, a)] + [(7, 7), (4, 3)]
    names = r.sample(range(-(10**12), 10**12), 4000)
    rows = [(names[a], names[b]) for a, b in edges]
    r.shuffle(rows)
    root = common.forest(4000, *(np.array(x) for x in zip(*edges, strict=True)))
    least = {c: min(names[k] for k in range(4000) if root[k] == c) for c in set(root)}
    want = {names[k]: least[root[k]] for k in {k for e in edges for k in e}}
    df = spark.createDataFrame(rows, "a long, b long")
    for few in (0, 900):
        monkeypatch.setattr(common, "FEW_LINKS", few)
        assert {x.node: x.root for x in common.components(df).collect()} == want
        assert len(rows) > few
    monkeypatch.undo()
    wide = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in wide}
    context, group = spark.sparkContext, "few links"
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        got = common.components(df)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {x.node: x.root for x in got.collect()} == want
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))
    assert 0 < tasks < 1000, tasks


@pytest.mark.parametrize("chunk", [4096, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(pq, "CHUNK", chunk)
    r = np.random.default_rng(7)
    x = r.normal(size=(400, 32))
    near = x[:40] + r.normal(size=(40, 32)) * 0.15
    group = x[50] + r.normal(size=(60, 32)) * 0.12
    every = np.concatenate([x, near, group, x[:5], x[5:10] * 3])
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(every)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [1.0, None] * 16), (9004, [float("nan")] * 32), (9005, [1.0] * 8), (9006, [1.0] * 8), (None, [1.0] * 8), (9007, [1e200] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumnRenamed("nope", "x")
    got = {r.vec_id: r for r in pq.dedup(df).collect()}
    u = every / np.linalg.norm(every, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, 0)
    links = s >= 0.95
    have = np.array([got[k].n_links for k in range(len(every))])
    want = links.sum(1)
    assert (have <= want).all() and have.sum() >= 0.98 * want.sum()  # none made up, recall
    root = common.forest(len(every), *np.nonzero(links))
    assert np.mean([got[k].component_id == root[k] for k in range(len(every))]) > 0.98
    for k in range(9000, 9005):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[9005].n_links == 2 and got[9006].component_id == 9005 and not got[9006].kept and got[None].component_id == 9005
    assert pq.dedup(df.limit(0)).count() == 0
