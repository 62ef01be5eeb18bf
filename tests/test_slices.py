"""Busy actors, whose rows are cut into slices of time, and ids with one prefix."""

import random
from datetime import datetime, timedelta

import pytest

from tracelight.operators import leaks, timeline

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    kinds = ["file_access", "file_access", "file_access", "archive_log", "transfer_log"]
    rows = [(i, "service" if i % 10 else "other", rng.choice(kinds), START + timedelta(seconds=rng.randrange(0, 400_000, 30))) for i in range(600)]
    return spark.createDataFrame(rows, "event_id long, actor string, source string, ts timestamp_ntz"), rows


def by_actor(rows):
    for actor in {r[1] for r in rows}:
        yield sorted((r for r in rows if r[1] == actor), key=lambda r: (r[3], r[0]))


@pytest.mark.parametrize("size", [600, 7_000, 86_400, 10_000_000])
def test_gaps_of_one_busy_actor(events, size):
    df, rows = events
    want = {}
    for own in by_actor(rows):
        segment, before = 0, None
        for r in own:
            gap = before and (r[3] - before).total_seconds() / 60
            segment += bool(gap and gap > 20)
            want[r[0]] = (segment, round(gap, 3) if gap and gap > 20 else None)
            before = r[3]
    got = {r.event_id: (r.segment, r.gap_minutes) for r in timeline.activity_gaps(df, 20, slice_seconds=size).collect()}
    assert got == want and max(s for s, _ in want.values()) > 20


@pytest.mark.parametrize("size", [600, 7_000, 86_400])
def test_trailing_events_of_one_busy_actor(events, size):
    df, rows = events
    want = {r[0]: sum(timedelta(0) <= r[3] - o[3] <= timedelta(hours=1) for o in own) for own in by_actor(rows) for r in own}
    got = {r.event_id: r.trailing for r in timeline.trailing_activity(df, 3600, slice_seconds=size).collect()}
    assert got == want


@pytest.mark.parametrize("size", [600, 86_400])
def test_staging_of_one_busy_actor(events, size):
    df, rows = events
    want = set()
    for own in by_actor(rows):
        for r in own:
            seen = sum(o[2] == "file_access" and timedelta(0) <= r[3] - o[3] <= timedelta(hours=1) for o in own)
            moved = any(o[2] == "transfer_log" and timedelta(0) < o[3] - r[3] <= timedelta(hours=2) for o in own)
            if r[2] == "archive_log" and seen >= 3 and not moved:
                want.add((r[0], seen))
    got = {(r.event_id, r.accesses) for r in timeline.staging_without_transfer(df, 2, 3, slice_seconds=size).collect()}
    assert got == want and want


def test_no_window_is_keyed_by_the_actor_alone(events):
    df = timeline.trailing_activity(df=events[0], seconds=60)
    assert "windowspecdefinition(actor#" in (plan := df._jdf.queryExecution().executedPlan().toString())
    assert "__slice" in plan.split("windowspecdefinition(")[1]


def test_aliases_of_ids_with_one_prefix(spark):
    ids = [f"user{i}" for i in random.Random(1).sample(range(10**6), 3000)]
    df = spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "id string")
    out, table = leaks.alias_ids(df, "id", "U")
    got = {r.id: r.alias for r in table.collect()}
    assert got == {v: f"U{n + 1:03d}" for n, v in enumerate(sorted(ids))}
    assert sorted(r.id_alias or "" for r in out.collect()) == sorted([*got.values(), got[ids[0]], ""])
