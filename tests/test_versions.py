"""Published versions: what readers see between the steps, and writers that race."""

import threading

import pytest

from tallyloom.sources.versions import Conflict, Versions


@pytest.fixture
def versions(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/t")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions_stay_as_they_were(spark, versions):
    with pytest.raises(LookupError):
        versions.read()
    assert versions.publish(spark.range(3)) == 1
    first = versions.read()
    assert versions.publish(spark.range(5), based_on=1, note="grown") == 2
    assert ids(first) == [0, 1, 2] and ids(versions.read(1)) == [0, 1, 2] and ids(versions.read()) == [0, 1, 2, 3, 4]
    assert versions.entry(2)["note"] == "grown" and versions.current() == 2


def test_an_empty_table_is_refused(spark, versions):
    versions.publish(spark.range(3))
    with pytest.raises(ValueError, match="empty"):
        versions.publish(spark.range(0))
    assert versions.current() == 1 and len(versions.folder.entries("data")) == 1
    assert versions.publish(spark.range(0), allow_empty=True) == 2 and versions.read().count() == 0


@pytest.mark.parametrize("step", ["write", "claim"])
def test_a_writer_that_stops_between_the_steps_changes_nothing(spark, versions, monkeypatch, step):
    versions.publish(spark.range(3))

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions.folder, step, stop)
        with pytest.raises(RuntimeError, match="lost"):
            versions.publish(spark.range(9))
    assert versions.current() == 1 and ids(versions.read()) == [0, 1, 2]
    assert versions.publish(spark.range(4)) == 2 and ids(versions.read()) == [0, 1, 2, 3]


def test_one_of_two_writers_on_one_base_wins(spark, versions):
    versions.publish(spark.range(3))
    assert versions.publish(spark.range(4), based_on=1) == 2
    with pytest.raises(Conflict):
        versions.publish(spark.range(5), based_on=1)
    assert ids(versions.read()) == [0, 1, 2, 3] and len(versions.folder.entries("data")) == 2


def test_a_writer_that_loses_the_rename_tries_the_next_number(spark, versions, monkeypatch):
    """Another writer takes the number after this one has looked which is next."""
    other = Versions(spark, versions.folder.path)
    claim, taken = versions.folder.claim, []

    def late(fresh, name):
        if not taken:
            taken.append(other.publish(spark.range(7)))
        return claim(fresh, name)

    monkeypatch.setattr(versions.folder, "claim", late)
    assert versions.publish(spark.range(2)) == 2
    assert taken == [1] and [ids(versions.read(n)) for n in (1, 2)] == [list(range(7)), [0, 1]]


def test_writers_at_once_all_get_their_own_number(spark, versions):
    got = []
    threads = [threading.Thread(target=lambda n=n: got.append((Versions(spark, versions.folder.path).publish(spark.range(n + 1)), n))) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in got) == [1, 2, 3, 4, 5, 6]
    assert all(versions.read(v).count() == n + 1 for v, n in got)


def test_vacuum_spares_what_is_kept_and_young(spark, versions):
    for n in range(1, 5):
        versions.publish(spark.range(n))
    spark.range(1).write.parquet(f"{versions.folder.path}/data/half")  # of a writer that stopped
    newest = max(t for _, t in versions.folder.entries("data"))
    assert versions.vacuum(2, 60_000, newest) == 0 and versions.numbers() == [1, 2, 3, 4]
    assert versions.vacuum(2, 60_000, newest + 120_000) == 3 and versions.numbers() == [3, 4]
    assert ids(versions.read(3)) == [0, 1, 2]
