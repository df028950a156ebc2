"""Keys, merges, timelines and expansions on small frames."""

from __future__ import annotations

import random

import pytest
from conftest import day, rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterlake.operators import expand, keys, merge, timeline


def test_keys_follow_the_order_over_many_partitions(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v INT, w INT").repartition(13)
    keyed = keys.assign_keys(df, ["w", "v"], "k", start=5)
    expected = sorted((w, v) for v, w in [(v, v % 7) for v in values])
    assert [(r.w, r.v, r.k) for r in keyed.orderBy("k").collect()] == [
        (w, v, 5 + i) for i, (w, v) in enumerate(expected)
    ]


def test_keys_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "v INT")
    assert keys.assign_keys(df, ["v"], "k").collect() == []


def test_dense_keys_count_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(keys, "DENSE_BLOCK", 10)
    ids = [i for i in range(10_001, 10_101) if i % 3]
    df = spark.createDataFrame([(i, i % 2) for i in ids] + [(10_004, 9)], "id INT, part INT")
    keyed = keys.assign_dense_keys(df, "id", "k", start=2, then_by=["part"])
    found = [(r.id, r.part) for r in keyed.orderBy("k").collect()]
    assert found == sorted([(i, i % 2) for i in ids] + [(10_004, 9)])
    assert rows(keyed, "k") == sorted([(i + 2,) for i in range(len(ids) + 1)], key=repr)


def test_next_key(spark):
    df = spark.createDataFrame([(3,), (9,)], "id INT")
    assert keys.next_key(df, "id") == 10
    assert keys.next_key(df.limit(0), "id") == 1


def test_date_key(spark):
    df = spark.createDataFrame([(day("2024-03-07"),), (day("9999-12-31"),)], "d DATE")
    assert rows(df.select(keys.date_key(F.col("d")))) == [(20240307,), (99991231,)]


def test_keep_one_prefers_the_order(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 1, 3), (1, 1, 5), (2, 0, 1)], "k INT, cur INT, src INT")
    one = merge.keep_one(df, ["k"], [F.desc("cur"), F.desc("src")])
    assert rows(one) == [(1, 1, 5), (2, 0, 1)]


@pytest.mark.parametrize("n", [3, 1200])
def test_top_n_below_and_beyond_the_native_limit(spark, n):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = merge.top_n_per_group(df, ["g"], [F.desc("v")], n, "rnk")
    expected = [(g, v, i + 1) for g in (0, 1) for i, v in enumerate(range(3998 + g, 3998 + g - 2 * n, -2))]
    assert rows(top) == sorted(expected, key=repr)


def test_insert_ignore_keeps_what_is_there(spark):
    old = spark.createDataFrame([(1, "old")], "k INT, v STRING")
    new = spark.createDataFrame([(1, "new"), (2, "new"), (2, "new")], "k INT, v STRING")
    assert rows(merge.insert_ignore(old, new, ["k"])) == [(1, "old"), (2, "new")]


def test_split_known(spark):
    df = spark.createDataFrame([(1,), (2,)], "k INT")
    known, unknown = merge.split_known(df, spark.createDataFrame([(2,)], "k INT"), "k")
    assert rows(known) == [(2,)] and rows(unknown) == [(1,)]


def _random_changes(n, seed, days=40, employees=6):
    rng = random.Random(seed)
    base = day("2024-01-01").toordinal()
    # A third of all rows belongs to employee 1.
    return [
        (
            1 if rng.random() < 1 / 3 else rng.randrange(2, employees),
            day("2024-01-01").fromordinal(base + rng.randrange(days)),
            i,
        )
        for i in range(n)
    ]


def test_successor_day_equals_a_lead_window(spark):
    df = spark.createDataFrame(_random_changes(500, 3), "e INT, d DATE, id INT").repartition(5)
    found = timeline.with_successor_day(df, "e", "d", ["id"], "next")
    lead = F.lead("d").over(Window.partitionBy("e").orderBy("d", "id"))
    columns = ["e", "d", "id", "next"]
    assert rows(found, *columns) == rows(df.withColumn("next", lead), *columns)


def test_version_as_of_equals_brute_force(spark):
    starts = sorted(set((e, d) for e, d, _ in _random_changes(60, 5)))
    versions = []
    for number, (e, d) in enumerate(starts):
        following = [x for x in starts if x[0] == e and x[1] > d]
        end = following[0][1] if following else day("9999-12-31")
        if e == 3 and not following:
            end = d.fromordinal(d.toordinal() + 2)  # a terminated last version
        versions.append((e, d, end, number))
    versions.append((2, starts[0][1], starts[0][1], 999))  # zero length: never valid
    probes = [(e, d, i) for e, d, i in _random_changes(300, 6, days=60, employees=8)]
    probes.append((1, None, 1000))
    expected = sorted(
        (
            (e, d, i, max((v for ve, s, x, v in versions if d and ve == e and s <= d < x), default=None))
            for e, d, i in probes
        ),
        key=repr,
    )
    found = timeline.version_as_of(
        spark.createDataFrame(probes, "e INT, d DATE, id INT"),
        spark.createDataFrame(versions, "e INT, s DATE, x DATE, v INT"),
        "e", "d", "s", "x", "v",
    )
    assert rows(found, "e", "d", "id", "v") == expected


def test_drop_constant_columns_ignores_absent_ones(spark):
    df = spark.createDataFrame([(1, 80)], "Age INT, StandardHours INT")
    assert expand.drop_constant_columns(df).columns == ["Age"]


@pytest.mark.parametrize("target", [1, 3, 7, 9])
def test_replicate_repeats_in_order(spark, target):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "x STRING")
    found = expand.replicate_to_target(base, ["x"], target)
    repeated = "abcabcabcabc"[:target]
    assert [r.x for r in found.orderBy("employee_id").collect()] == list(repeated)
    assert rows(found, "employee_id") == sorted(((10001 + i,) for i in range(target)), key=repr)


def test_zip_rows(spark):
    left = spark.createDataFrame([("b",), ("a",)], "x STRING")
    right = spark.createDataFrame([(20,), (10,), (30,)], "y INT")
    assert rows(expand.zip_rows(left, ["x"], right, ["y"])) == [("a", 10), ("b", 20)]


def test_history_rules(spark):
    today = F.lit("2026-08-15").cast("date")
    people = [
        # id, hire, offset, history, level, department
        (1, day("2026-01-01"), 400, True, 1, 3),  # short tenure: 180 days
        (2, day("2020-01-01"), 2000, True, 4, 1),  # capped at 1095 days
        (3, day("2025-06-01"), 500, True, 2, 2),  # capped at tenure - 30
        (4, day("2020-01-01"), 100, True, 2, 2),  # at least 180 days
        (5, day("2021-01-01"), 300, False, 2, 2),
    ]
    df = spark.createDataFrame(
        [(i, h, o, y, lv, d, 1999) for i, h, o, y, lv, d in people],
        "id INT, hire_date DATE, o INT, y BOOLEAN, JobLevel INT, department_id INT, MonthlyIncome INT",
    )
    versions = expand.expand_history(
        df, today, F.col("y"), F.col("o"), F.lit("0.75").cast("decimal(4,2)"),
        F.col("id") == 1, F.lit("Annual Merit Increase"),
    )
    found = {
        (r.id, r.is_current): r for r in versions.collect()
    }
    assert len(found) == 9
    assert found[1, 0].effective_end_date == day("2026-06-30")
    assert (found[1, 0].MonthlyIncome, found[1, 0].JobLevel, found[1, 0].department_id) == (1499, 1, 1)
    assert found[2, 1].effective_start_date == day("2022-12-31")
    assert found[2, 0].JobLevel == 3 and found[2, 0].department_id == 1
    assert (day("2026-08-15") - found[3, 0].effective_end_date).days == 30
    assert found[4, 0].effective_end_date == day("2020-06-29")
    assert found[5, 1].change_reason == "Initial Onboarding"
    assert found[5, 1].effective_start_date == day("2021-01-01")
