"""Upkeep of a tree: untouched folders stay as they are, drift needs two runs, dirty subtrees equal a rebuild of their units."""

import random
import shutil

import numpy as np
import pytest

from quarry.operators import upkeep as U

GROUPS, SIZE, DIM = 4, 8, 12


def unit(i, group, rnd, noise=0.05):
    v = np.eye(DIM)[group] + np.array([rnd.uniform(-noise, noise) for _ in range(DIM)])
    return i, group % 2, v.tolist()


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rnd = random.Random(7)
    units = [unit(g * 100 + i, g, rnd) for g in range(GROUPS) for i in range(SIZE)]
    edges = [(a[0], b[0], 0.9) for a in units for b in units if a[0] < b[0] and a[0] // 100 == b[0] // 100]
    root = tmp_path_factory.mktemp("built") / "tree"
    U.create(spark.createDataFrame(units, "id long, part int, vec array<double>"), graph(spark, edges), str(root), 12, 4)
    return root, units, edges


@pytest.fixture()
def tree(built, tmp_path):
    root, units, edges = built
    shutil.copytree(root, tmp_path / "tree")
    return f"{tmp_path}/tree", units, edges, random.Random(5)


def files(root, tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("members/**/*.parquet")}


def members(spark, root):
    return {r.id: (r.part, r.subtree, r.leaf) for r in U._read(spark, root, "array<double>", "long").collect()}


def delta(spark, rows):
    return spark.createDataFrame(rows, "id long, part int, vec array<double>")


def graph(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight double")


def test_units_join_their_leaf_and_other_folders_stay(spark, tree, tmp_path):
    root, units, edges, rnd = tree
    before, old = members(spark, root), files(root, tmp_path)
    assert len(before) == len(units) and len({v for v in before.values()}) == GROUPS
    new = [unit(1000 + i, 2, rnd) for i in range(3)]
    report = U.update(delta(spark, new), graph(spark, edges), root, 1, 12).collect()
    after, now = members(spark, root), files(root, tmp_path)
    assert all(after[n[0]] == before[200] for n in new) and {k: after[k] for k in before} == before
    part, subtree, _ = before[200]
    assert {f for f in set(old) ^ set(now)} and all(f"part={part}/subtree={subtree}" in f for f in set(old) ^ set(now))
    assert all(old[f] == now[f] for f in set(old) & set(now))
    assert len(report) == 1 and not report[0].drifted and report[0].violations == 0 and report[0].outlier_ratio == 0
    # the same batch again changes nothing
    U.update(delta(spark, new), graph(spark, edges), root, 1, 12)
    assert members(spark, root) == after


def test_drift_needs_two_runs_and_rebuilds_only_its_subtree(spark, tree, tmp_path):
    root, units, edges, rnd = tree
    before = members(spark, root)
    grown = [unit(1000 + i, 0, rnd) for i in range(6)]  # 14 units in a leaf of 12
    first = U.update(delta(spark, grown[:5]), graph(spark, edges), root, 1, 12).first()
    assert first.overflow and first.violations == 1 and not first.drifted
    assert len({v for k, v in members(spark, root).items() if v == before[0]}) == 1
    # the newcomers hang together, as do the old ones
    more = edges + [(a[0], b[0], 0.9) for a in grown for b in grown if a[0] < b[0]]
    old = files(root, tmp_path)
    second = U.update(delta(spark, grown[5:]), graph(spark, more), root, 2, 12).first()
    assert second.violations == 2 and second.drifted
    after, now = members(spark, root), files(root, tmp_path)
    part, subtree, _ = before[0]
    assert all(f"part={part}/subtree={subtree}" in f for f in set(old) ^ set(now))
    own = {k: v for k, v in after.items() if v[:2] == (part, subtree)}
    leaves: dict = {}
    for k, v in own.items():
        leaves.setdefault(v[2], set()).add(k)
    assert sorted(map(len, leaves.values())) == [6, 8] and {frozenset(x) for x in leaves.values()} == {frozenset(r[0] for r in grown), frozenset(range(SIZE))}
    # a rebuild of the same units from nothing gives the same leaves
    alone = U.rebuild(spark.createDataFrame([(k, "x") for k in own], "id long, part string"), graph(spark, more), 12)
    again: dict = {}
    for r in alone.collect():
        again.setdefault(r.leaf, set()).add(r.id)
    assert again == leaves


def test_outliers_count_and_a_calm_run_resets(spark, tree):
    root, units, edges, rnd = tree
    old = spark.createDataFrame([(r[0], str(r[1]), "s", f"l{r[0] // 100}", r[2]) for r in units], "id long, part string, subtree string, leaf string, vec array<double>")
    placed = lambda *rows: U.place(spark.createDataFrame(rows, "id long, part string, vec array<double>"), old)
    far, near = (2000, "1", (-np.ones(DIM)).tolist()), (2001, "1", units[-1][2])
    first = U.drift(old, placed(far), None, 12).first()
    assert first.outlier_ratio == 1 and first.violations == 1 and not first.drifted
    counts = spark.createDataFrame([("1", "s", f"l{units[-1][0] // 100}", 1)], "part string, subtree string, leaf string, violations int")
    assert U.drift(old, placed(near), counts, 12).first().violations == 0
    assert U.drift(old, placed(near), counts, SIZE).first().violations == 2


def test_a_stream_of_deltas(spark, tree, tmp_path):
    root, units, edges, rnd = tree
    for i in range(2):
        delta(spark, [unit(3000 + 10 * i + j, 3, rnd) for j in range(2)]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("id long, part int, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    U.follow(stream, graph(spark, edges), root, f"{tmp_path}/checkpoint", 12).awaitTermination()
    found = members(spark, root)
    assert {found[i] for i in (3000, 3001, 3010, 3011)} == {found[300]} and len(found) == len(units) + 4


def test_partitions_without_a_leaf_take_nothing(spark, tree):
    root, units, *_ = tree
    old = U._read(spark, root, "array<double>", "long")
    assert U.place(spark.createDataFrame([(5000, "77", [1.0] * DIM)], "id long, part string, vec array<double>"), old).count() == 0
