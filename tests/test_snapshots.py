"""A snapshot at any cut and the days since give what the whole log gives, and only those days are read."""

import datetime
import random
import re

import pytest

from vitrine.operators import events, snapshots

LOG = "id long, ts timestamp_ntz, user_id long, image_id long, kind string"
DAY = datetime.timedelta(days=1)
START = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(11)
    kinds = ["VIEW", "CLICK", "SHARE", "LIKE", "FAVORITE", "LIKE", "FAVORITE", "COMMENT", "OTHER"]
    rows = []
    for k in range(1500):
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(6 * 24 * 60))
        image = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None])
        rows.append((k, ts, rng.choice([1, 2, 3, None]), image, rng.choice(kinds)))
    folder = str(tmp_path_factory.mktemp("log") / "days")
    table = spark.createDataFrame(rows, LOG)
    snapshots.write_log(table, folder)
    return table, folder


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("cuts", [[3], [1, 2, 5], [6]])
def test_snapshot_and_tail_are_the_full_run(spark, log, tmp_path, cuts):
    table, folder = log
    state, start = snapshots.empty(spark), datetime.date(1, 1, 1)
    for k, cut in enumerate(cuts):
        cut = START + cut * DAY
        snapshots.save(snapshots.advance(state, snapshots.days(spark, folder, start, cut), cut), str(tmp_path / f"s{k}"))
        state, start = snapshots.load(spark, str(tmp_path / f"s{k}")), cut
    assert state.cut == start
    now = snapshots.advance(state, snapshots.days(spark, folder, start), datetime.date.max)
    same(events.clamped_score(events.effects(table)), snapshots.scores(now))
    same(events.counters(table), snapshots.counters(now))
    same(events.toggle_state(table), snapshots.toggle_state(now))


def test_only_the_days_since_are_read(spark, log):
    rows = snapshots.days(spark, log[1], START + 4 * DAY)
    assert re.search(r"PartitionFilters: \[[^]]*day#\d+ >= ", rows._jdf.queryExecution().executedPlan().toString())
    read = {re.search(r"day=([\d-]+)", r[0])[1] for r in rows.selectExpr("_metadata.file_path").distinct().collect()}
    assert read == {"2024-01-05", "2024-01-06"}
