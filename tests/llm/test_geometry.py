import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.llm import knn_forest, overlap, queries, quota, reach, split


def linkage(x, r):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= r * r
    lab = np.arange(len(x))
    while True:
        new = np.where(near, lab[None], len(x)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def blobs(seed, n, dims, spread, groups=8):
    r = np.random.default_rng(seed)
    return r.uniform(-60, 60, (groups, dims))[r.integers(groups, size=n)] + r.normal(0, spread, (n, dims))


@pytest.mark.parametrize("spread", [0.2, 1.0, 3.0, 8.0])
def test_local_groups_are_single_linkage(spread):
    x = blobs(1, 250, 6, spread)
    assert (reach.local_groups(x, 10.0) == linkage(x, 10.0)).all()
    assert (reach.local_groups(np.cumsum(np.random.default_rng(2).normal(0, 3, (150, 6)), 0), 8.0) == linkage(np.cumsum(np.random.default_rng(2).normal(0, 3, (150, 6)), 0), 8.0)).all()


def frame(spark, x, first=100):
    return spark.createDataFrame([(first + i, [float(v) for v in p], "x") for i, p in enumerate(x)], "node_id long, pos array<double>, label string")


def test_local_groups_of_many_rows_and_of_one_dense_cell():
    x = blobs(8, 3000, 6, 6.0, 40)
    assert (reach.local_groups(x, 10.0) == linkage(x, 10.0)).all()
    same = np.repeat(np.random.default_rng(3).normal(size=(4, 5)), 5000, 0)
    assert (reach.local_groups(same, 10.0) == 0).all()


def test_reach_groups_of_a_dense_cell(spark):
    # More rows within a few reaches than a task may hold, two groups and strays among them.
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(0, 0.25, (900, 3)), r.normal(0, 0.25, (500, 3)) + [0, 0, 4.5], r.uniform(-3, 3, (60, 3))])[r.permutation(1460)]
    got = {v["id"]: v["label"] for v in reach.reach_groups(frame(spark, x, 0), "node_id", "pos", 3, 0.9, rows_per_cell=50, rows_per_task=200).collect()}
    assert [got[i] for i in range(len(x))] == linkage(x, 0.9).tolist()


@pytest.mark.parametrize("task_rows", [10**9, 60])
def test_reach_groups_over_cells_and_blocks(spark, task_rows):
    x = blobs(3, 400, 5, 2.5)
    got = {r["id"]: r["label"] for r in reach.reach_groups(frame(spark, x), "node_id", "pos", 5, 6.0, cell_width=25.0, rows_per_cell=20, rows_per_task=task_rows).collect()}
    assert [got[100 + i] - 100 for i in range(len(x))] == linkage(x, 6.0).tolist()


def test_reach_groups_small_and_empty(spark):
    f = frame(spark, np.zeros((3, 2)))
    assert {r["label"] for r in reach.reach_groups(f, "node_id", "pos", 2, 1.0).collect()} == {100}
    assert reach.reach_groups(f.filter("false"), "node_id", "pos", 2, 1.0).count() == 0


def test_chain_across_many_cells(spark):
    x = np.stack([np.arange(300) * 0.9, np.zeros(300)], 1)
    g = reach.reach_groups(frame(spark, x), "node_id", "pos", 2, 1.0, cell_width=5.0, rows_per_cell=5)
    assert {r["label"] for r in g.collect()} == {100}


def test_describe_groups(spark):
    x = np.concatenate([np.zeros((6, 2)), np.full((5, 2), 3.0), np.full((2, 2), 90.0)])
    f = frame(spark, x)
    d = reach.describe_groups(f, reach.reach_groups(f, "node_id", "pos", 2, 5.0), "node_id", "pos", 2, 2.0).collect()
    assert [tuple(r) for r in d] == [(100, 11, [100, 101, 102])]


def test_clusters_and_members_hold_every_usable_node(spark, tmp_path):
    x = np.concatenate([np.zeros((12, 20)), np.full((3, 20), 50.0), np.full((1, 20), 500.0)])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    f = spark.createDataFrame(rows, "node_id long, pos array<float>").withColumn("received_at", F.timestamp_seconds(F.lit(1)))
    f.write.parquet(f"{tmp_path}/feature_nodes.parquet")
    got = sorted((r["anchor_id"], r["size"]) for r in queries.p5_clusters(spark, str(tmp_path)).collect())
    assert got == [(0, 12), (12, 3), (15, 1)]
    assert sorted(tuple(r) for r in queries.p5_members(spark, str(tmp_path)).collect()) == [(i, 0 if i < 12 else min(i, 12) if i < 15 else 15) for i in range(16)]


def test_knn_forest_is_exact_when_small_and_close_when_large(spark):
    x = blobs(4, 900, 8, 1.0, 12)
    x[5] = x[4]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :4]

    def found(**k):
        out = np.full((len(x), 4), -1)
        for r in knn_forest.knn_forest(frame(spark, x, 0), "node_id", "pos", 8, 4, **k).collect():
            out[r["node"], r["rank"] - 1] = r["neighbor"]
        return out

    assert (found(trees=2, leaf=2048) == want).all()
    near = found(trees=6, leaf=128)
    recall = np.mean([len(set(a) & set(b)) / 4 for a, b in zip(near, want, strict=True)])
    assert recall >= 0.9, recall


def test_knn_forest_edges(spark):
    one = frame(spark, np.zeros((1, 3)))
    assert knn_forest.knn_forest(one, "node_id", "pos", 3).count() == 0
    assert knn_forest.knn_forest(one.filter("false"), "node_id", "pos", 3).count() == 0
    many = knn_forest.knn_forest(frame(spark, np.zeros((50, 3)), 0), "node_id", "pos", 3, 3, trees=1).collect()
    assert {(r["node"], r["rank"]): r["neighbor"] for r in many}[(9, 3)] == 2


def test_knn_forest_copies_and_a_far_row(spark):
    r = np.random.default_rng(11)
    x = np.concatenate([np.full((400, 4), 2.5), r.normal(0, 1, (500, 4)), [[1e9, 0, 0, 0]]])[r.permutation(901)]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :3]
    got = np.full((len(x), 3), -1)
    for e in knn_forest.knn_forest(frame(spark, x, 0), "node_id", "pos", 4, 3, trees=2, leaf=16).collect():
        got[e["node"], e["rank"] - 1] = e["neighbor"]
    assert (got == want).all()


def test_knn_forest_of_twenty_thousand_equal_vectors_in_many_stretches(spark):
    r = np.random.default_rng(13)
    x = np.concatenate([np.full((20_000, 4), 1.5), r.normal(0, 1, (600, 4))])
    edges = knn_forest.knn_forest(frame(spark, x, 0), "node_id", "pos", 4, 3, leaf=64, rows_per_task=200).toPandas().sort_values(["node", "rank"])
    got = edges["neighbor"].to_numpy().reshape(-1, 3)
    assert len(got) == len(x)
    first = np.array([[j for j in range(4) if j != i][:3] for i in range(20_000)])
    assert (got[:20_000] == first).all()
    near = np.concatenate([np.arange(4), np.arange(20_000, 20_600)])
    d = ((x[20_000:, None] - x[near][None]) ** 2).sum(2)
    d[np.arange(600), np.arange(600) + 4] = np.inf
    want = near[np.lexsort((np.broadcast_to(near, d.shape), d), axis=1)[:, :3]]
    assert (got[20_000:] == want).all()


def test_repaired_counts_are_optimal():
    r = np.random.default_rng(5)
    for seed in range(30):
        e = r.integers(0, 12, 4)
        t = r.uniform(0, 6, 4)
        low, n = r.integers(0, 3, 4), int(r.integers(3, 12))
        have = quota.repaired_counts(e, t, low, n, seed)
        floor = np.minimum(low, e)
        size = min(max(n, floor.sum()), e.sum())
        assert have.sum() == size and (have <= e).all() and (have >= floor).all()
        best = min(((np.array(c) - t) ** 2).sum() for c in np.ndindex(*(e + 1)) if sum(c) == size and (np.array(c) >= floor).all())
        assert ((have - t) ** 2).sum() == pytest.approx(best)


def test_many_swaps_take_few_exchanges():
    e = np.array([10**9, 10**9, 10**9, 10**6])
    have = quota.repaired_counts(e, np.array([7e8, 2e8, 99e6, 2e6]), np.array([5, 5, 5, 5]), 1_001_000_000)
    assert have.sum() == 1_001_000_000 and have[3] == 10**6
    assert np.ptp(have[:3] - np.array([7e8, 2e8, 99e6])) <= 1


def test_bodies_of_points_that_coincide():
    x = np.concatenate([np.zeros((20_000, 3)), np.full((20_000, 3), 0.9), np.full((5, 3), 9.0)])
    label = split.bodies(np.zeros(len(x), np.int64), x, np.full(len(x), 1.6))
    assert (label[:40_000] == 0).all() and (label[40_000:] == 40_000).all()
    apart = split.bodies(np.zeros(len(x), np.int64), x, np.full(len(x), 0.5))
    assert (apart[20_000:40_000] == 20_000).all()


def test_bodies_are_single_linkage():
    for seed in range(5):
        x = np.random.default_rng(seed).uniform(0, 6, (300, 3))
        assert (split.bodies(np.zeros(300, np.int64), x, np.full(300, 0.7)) == linkage(x, 0.7)).all()


def test_quota_sample(spark):
    rows = [(i, "d", i % 3) for i in range(300)] + [(300 + i, "d", 3) for i in range(2)] + [(400, "d", None), (401, None, 1), (402, "d", 9)]
    rec = spark.createDataFrame([(*r, 5) for r in rows], "object_id long, dataset string, y long, sampled int")
    tar = spark.createDataFrame([("d", 0, 0.5, 2, 0.3), ("d", 1, 0.3, 2, 0.3), ("d", 2, 0.19, 2, 0.3), ("d", 3, 0.01, 4, 0.3), ("e", 0, 1.0, 1, 0.3)], "dataset string, y long, target_share double, min_rows long, sample_share double")
    q = quota.QuotaSample(rec.drop("sampled"), tar, ["dataset", "y"], ["dataset"], "object_id")
    rep = {(r["dataset"], r["y"]): r for r in q.report().collect()}
    assert {k for k, r in rep.items() if not r["met"]} == {("d", 3), ("e", 0)}
    got = q.sample().collect()
    count = {y: sum(r["y"] == y for r in got) for y in range(4)}
    assert count == {y: rep[("d", y)]["sampled"] for y in range(4)} and len({r["object_id"] for r in got}) == len(got) == 91
    assert count[3] == 2 and abs(count[0] - 45.3) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, q.sample().collect()))
    empty = quota.QuotaSample(rec.filter("false"), tar, ["dataset", "y"], ["dataset"], "object_id")
    assert empty.report().filter("met").count() == 0 and empty.sample().count() == 0


def moved(p, seed, swap=False, noise=0.0, drop=0, add=0):
    r = np.random.default_rng(seed)
    a = r.uniform(0, 6.28)
    q = p[r.permutation(len(p))[drop:]]
    q = np.concatenate([q, r.uniform(p.min(0), p.max(0), (add, 3))])
    q = q @ np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]).T * r.uniform(0.5, 2)
    q = q + r.uniform(-1, 1, q.shape) * noise * np.ptp(q, axis=0).max() + r.normal(size=3)
    return q[:, [0, 2, 1]] if swap else q


def test_near_copies(spark):
    r = np.random.default_rng(6)
    base = [r.normal(size=(60, 3)) * [1, 0.6, 0.8] for _ in range(12)]
    rows = [(i, True, p) for i, p in enumerate(base)]
    rows += [(100, False, base[0]), (101, False, moved(base[1], 1)), (102, False, moved(base[2], 2, swap=True)), (103, False, moved(base[3], 3, noise=0.008)), (104, None, moved(base[4], 4, drop=10)), (105, False, moved(base[5], 5, add=10)), (106, False, moved(base[6], 6).round(2))]
    rows += [(107, False, moved(base[7], 7) * [1, 1.5, 1]), (108, False, np.concatenate([base[8][:30], r.normal(size=(30, 3))])), (109, False, r.normal(size=(60, 3))), (110, False, base[0]), (111, True, base[0])]
    data = [(i, t, [[float(v) for v in x] for x in p], 1) for i, t, p in rows]
    data += [(200, False, None, 1), (201, True, [], 1), (202, False, [[float("nan")] * 3] * 20, 1), (203, False, [[1.0, 2.0, 3.0]] * 20, 1), (204, True, [None, [1.0], [None, 1.0, 2.0]], 1)]
    df = spark.createDataFrame(data, "object_id long, train boolean, pos array<array<double>>, key int")
    got = sorted(tuple(x) for x in overlap.near_copies(df, "object_id", "pos", "train").collect())
    want = [(100, 0), (100, 111), (101, 1), (102, 2), (103, 3), (104, 4), (105, 5), (106, 6), (110, 0), (110, 111)]
    assert got == want
    assert overlap.near_copies(df.filter("false"), "object_id", "pos", "train").count() == 0


def test_near_copies_shuffle_shapes_and_not_their_passages(spark):
    r = np.random.default_rng(16)
    base = [r.uniform(-1, 1, (60, 3)) for _ in range(120)]
    rows = [(i, True, p) for i, p in enumerate(base)] + [(200 + i, False, moved(p, i, noise=0.005)) for i, p in enumerate(base)]
    df = spark.createDataFrame([(i, t, [[float(v) for v in x] for x in p]) for i, t, p in rows], "object_id long, train boolean, pos array<array<double>>")

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    # Blocks and files of a few shapes: pairs of shapes lie in different ones.
    got = sorted(tuple(x) for x in overlap.near_copies(df, "object_id", "pos", "train", shapes_per_block=20, shapes_per_file=30).collect())
    assert got == [(200 + i, i) for i in range(120)]
    assert shuffled() - before < 4 * len(rows) * 60 * 3 * 8


def test_near_copies_at_the_limits_of_noise_and_missing_points():
    for n, least in ((12, 0.9), (20, 0.9), (48, 0.9)):
        met = 0
        for seed in range(30):
            r = np.random.default_rng((n, seed))
            p = r.uniform(-1, 1, (n, 3)) * r.uniform(0.3, 1, 3)
            q = moved(p, seed, noise=0.02, drop=n // 5)
            te, ne, _, _ = overlap.passages(q[None], False)
            tt = overlap.passages(p[None], True)[0]
            common = np.isin(overlap._hashes(te[0]), overlap._hashes(tt[0]))
            met += len(np.unique(ne[common])) >= 5 and overlap.shared_share(q, p) >= 0.68
        assert met >= least * 30, (n, met)


def scans(seed, sizes, reach_=1.0):
    """Bodies along the x axis, far apart; returns positions."""
    r = np.random.default_rng(seed)
    return np.concatenate([np.cumsum(r.uniform(-0.3, 0.3, (n, 3)), 0) * 0.3 + [i * 40.0, 0, 0] for i, n in enumerate(sizes)])


def split_frames(spark, sets, limits):
    rows = [(c, i, [float(v) for v in p], 10) for c, x in sets.items() for i, p in enumerate(x)]
    points = spark.createDataFrame(rows, "cloud_id long, node_id long, pos array<double>, t int").withColumn("received_at", F.timestamp_seconds("t")).drop("t")
    return points, spark.createDataFrame([(c, *v) for c, v in limits.items()], "cloud_id long, capacity long, overlap long, reach double")


def check_pieces(got, sets, limits):
    for c, x in sets.items():
        cap, over, r = limits[c]
        mine = [v for v in got if v["cloud_id"] == c]
        if len(x) <= cap:
            assert not mine
            continue
        own = [v for v in mine if not v["shared"]]
        assert sorted(v["node_id"] for v in own) == list(range(len(x)))
        lab = linkage(np.array(x), r)
        assert {v["node_id"]: v["body"] for v in own} == dict(enumerate(lab.tolist()))
        pieces = {}
        for v in sorted(mine, key=lambda v: (v["piece"], v["seq"])):
            pieces.setdefault(v["piece"], []).append(v)
        previous = None
        for _, p in sorted(pieces.items()):
            assert len(p) <= cap and [v["seq"] for v in p] == list(range(len(p)))
            if previous is not None:
                n = sum(v["shared"] for v in p)
                assert n == min(over, cap - 1, len(previous)) or n == over
                assert [v["node_id"] for v in p[:n]] == [v["node_id"] for v in previous[-n:]]
            previous = p


@pytest.mark.parametrize("rows_per_set", [10**6, 100])
def test_split(spark, rows_per_set):
    sets = {1: scans(1, [40, 70, 25, 15, 200]), 2: scans(2, [30, 20]), 3: scans(3, [150])}
    limits = {1: (80, 7, 1.0), 2: (80, 7, 1.0), 3: (60, 5, 1.0)}
    points, lim = split_frames(spark, sets, limits)
    got = split.split_oversized(points, lim, rows_per_set=rows_per_set, rows_per_task=1000).collect()
    check_pieces(got, sets, limits)


def test_split_is_the_same_for_sets_of_any_size(spark):
    sets = {1: scans(1, [40, 70, 25, 15, 200]), 3: scans(3, [150])}
    points, lim = split_frames(spark, sets, {1: (80, 7, 1.0), 3: (60, 5, 1.0)})
    whole, parts = (sorted(map(tuple, split.split_oversized(points, lim, rows_per_set=n, rows_per_task=60).collect())) for n in (10**6, 100))
    assert whole == parts


def test_split_of_sets_with_many_reaches(spark):
    sets = {c: scans(c, [12, 9]) for c in range(1200)}
    points, lim = split_frames(spark, sets, {c: (15, 2, 1.0 + c / 5000) for c in sets})
    got = split.split_oversized(points, lim, rows_per_set=10).filter("not shared").groupBy("cloud_id").count().collect()
    assert len(got) == 1200 and {r["count"] for r in got} == {21}


def test_cuts_prefer_bodies_and_are_local():
    body = np.repeat(np.arange(20), 30)
    none = np.zeros(len(body), bool)
    c = split.cuts(body, none, 100, 10)
    assert all(x % 30 == 0 for x in c[:-1]) and c[-1] == 600
    assert split.cuts(np.zeros(10, int), none[:10], 100, 10) == [10]
    long = split.cuts(np.zeros(1000, int), none, 100, 10)
    assert max(b - a for a, b in zip([0, *long], long)) <= 100  # noqa: B905
    r = np.random.default_rng(9)
    x = r.normal(size=(5000, 3))
    y = np.concatenate([x[:500], r.normal(size=(3, 3)), x[500:]])
    ends = []
    for z in (x, y):
        m = split.landmarks(np.zeros(len(z), int), z, np.full(len(z), 0.25), 32)
        ends.append(split.cuts(np.zeros(len(z), int), m, 200, 0))
    moved_back = {e - 3 if e > 500 else e for e in ends[1]}
    assert len(moved_back & set(ends[0])) > 0.8 * len(ends[0]), "an edit alters only the pieces near it"


def test_split_uses_current_usable_points(spark):
    x = scans(4, [30, 30])
    points, lim = split_frames(spark, {1: x}, {1: (40, 4, 1.0)})
    stale = points.filter("node_id = 0").withColumn("pos", F.array(*[F.lit(999.0)] * 3)).withColumn("received_at", F.timestamp_seconds(F.lit(1)))
    broken = points.limit(1).selectExpr("cloud_id", "1000 as node_id", "array(double('nan'), 1d, 1d) as pos", "received_at")
    absent = points.limit(1).selectExpr("cloud_id", "1001 as node_id", "cast(null as array<double>) as pos", "received_at")
    nokey = points.limit(1).selectExpr("cast(null as long) as cloud_id", "5L as node_id", "pos", "received_at")
    noise = points.unionByName(stale).unionByName(points.limit(20)).unionByName(broken).unionByName(absent).unionByName(nokey).withColumn("body", F.lit(1))
    got = split.split_oversized(noise, lim).collect()
    check_pieces(got, {1: x}, {1: (40, 4, 1.0)})
    assert split.split_oversized(points.filter("false"), lim).count() == 0
    assert split.split_oversized(points, lim.withColumn("capacity", F.lit(None).cast("long"))).count() == 0
