"""Appends that are seen whole or not at all."""

from datetime import date

import pytest

from hazelake import schemas
from hazelake.sources import commits


def totals(spark, *rows):
    return spark.createDataFrame([(date(2024, 1, d), name, 1.0, 1.0, 1.0) for d, name in rows], schemas.HOTSPOT_DAILY)


def held(spark, path):
    return sorted((r.date.day, r.Province) for r in commits.read(spark, path, schemas.HOTSPOT_DAILY).collect())


def test_two_interleaved_loads_do_not_both_add_a_date(spark, tmp_path):
    """While the first load stands between writing and committing, another commits: the first looks again."""
    path = str(tmp_path / "t")
    calls = []

    def other_load(attempt):
        calls.append(held(spark, path))
        if attempt == 0:
            assert commits.append(totals(spark, (2, "b"), (3, "b")), path, "date", run="second")
        elif attempt == 1:
            assert commits.append(totals(spark, (4, "c")), path, "date", run="third")

    assert commits.append(totals(spark, (1, "a"), (2, "a"), (4, "a")), path, "date", run="first", before_claim=other_load)
    assert calls == [[], [(2, "b"), (3, "b")], [(2, "b"), (3, "b"), (4, "c")]]  # readers never see the first load in part
    assert held(spark, path) == [(1, "a"), (2, "b"), (3, "b"), (4, "c")]
    assert [e["run"] for e in commits.latest(spark, path)[1]] == ["second", "third", "first"]


def test_a_load_that_broke_off_leaves_nothing_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")

    def lost(attempt):
        raise RuntimeError("driver lost")

    commits.append(totals(spark, (1, "a")), path, "date", run="1")
    with pytest.raises(RuntimeError):
        commits.append(totals(spark, (2, "a"), (3, "a")), path, "date", run="2", before_claim=lost)
    assert held(spark, path) == [(1, "a")]
    assert commits.append(totals(spark, (2, "a"), (3, "a")), path, "date", run="2")
    assert not commits.append(totals(spark, (9, "z")), path, "date", run="2")  # committed before
    assert held(spark, path) == [(1, "a"), (2, "a"), (3, "a")]


def test_keys_pick_up_stations_that_an_earlier_load_lacked(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.append(totals(spark, (1, "a")), path, "date", ["Province"], run="1")
    commits.append(totals(spark, (1, "a"), (1, "b")), path, "date", ["Province"], run="2")
    commits.append(totals(spark), path, "date", ["Province"], run="empty")
    assert held(spark, path) == [(1, "a"), (1, "b")]


def test_a_number_is_claimed_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert held(spark, path) == []
    with pytest.raises(ValueError):
        commits.read(spark, path)
    assert commits.claim(spark, path, 0, []) and not commits.claim(spark, path, 0, [{"run": "x", "folder": "y"}])
    assert commits.latest(spark, path) == (0, [])
