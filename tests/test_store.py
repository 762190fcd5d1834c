"""The store's commits: whole or not at all, one winner, old states readable."""

import pytest
from pyspark.sql import functions as F

from quillstone.sources import store


class Stopped(Exception):
    pass


@pytest.fixture
def filled(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.init()
    one, two = s.add_user("a@x.org", "Ann", "h"), s.add_user("b@x.org", "Bo", "h")
    s.add_documents(documents(spark, [(one, "d0"), (one, "d1"), (two, "e0")]))
    return s, one, two


def documents(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, id string")
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in store.DOCUMENTS if f.name not in ("user_id", "id", "created_at")))


def state(s):
    return sorted(r.email for r in s.users().collect()), sorted((r.user_id, r.id) for r in s.documents().collect())


def test_a_stop_at_every_step_leaves_a_whole_state(spark, filled, monkeypatch):
    """A writer is stopped before and after each of its file operations; the state is the old or the new one."""
    s, one, two = filled
    changes = [lambda: s.delete_document("d0", one), lambda: s.add_documents(documents(spark, [(two, "e1")])), lambda: s.delete_user(one), lambda: s.add_user("c@x.org", "Cy", "h"), s.compact]
    for change in changes:
        before = state(s)
        for name in ("_written", "_commit"):
            real = getattr(store.Store, name)
            for early in (True, False):

                def stopping(self, *args, real=real, early=early, name=name, **more):
                    if early:
                        raise Stopped
                    real(self, *args, **more)
                    raise Stopped

                if (name, early) == ("_commit", False):
                    continue  # the change is made then; it is made below
                monkeypatch.setattr(store.Store, name, stopping)
                with pytest.raises(Stopped):
                    change()
                monkeypatch.setattr(store.Store, name, real)
                assert state(s) == before
        change()
        assert (state(s) != before) == (change != s.compact)
    assert state(s) == (["b@x.org", "c@x.org"], [(two, "e0"), (two, "e1")])


def test_two_writers_of_one_address(spark, filled, monkeypatch):
    """A second writer commits between the first one's look and commit: one wins, the other is told."""
    s, one, two = filled
    other = store.Store(spark, s.root)
    real, done = store.Store._commit, []

    def late(self, version, adds, whole=False):
        if self is s and not done:
            done.append(other.add_user("c@x.org", "Other", "h"))
        return real(self, version, adds, whole)

    monkeypatch.setattr(store.Store, "_commit", late)
    with pytest.raises(ValueError, match="taken"):
        s.add_user("c@x.org", "Cy", "h")
    assert [r.full_name for r in s.user_by_email("c@x.org").collect()] == ["Other"]
    assert len({one, two, *done}) == 3


def test_a_late_writer_tries_again(spark, filled, monkeypatch):
    """Another address came first: the change is made on the newer state, with another id."""
    s, one, two = filled
    other = store.Store(spark, s.root)
    real, done = store.Store._commit, []

    def late(self, version, adds, whole=False):
        if self is s and not done:
            done.append(other.add_user("d@x.org", "Di", "h"))
        return real(self, version, adds, whole)

    monkeypatch.setattr(store.Store, "_commit", late)
    new = s.add_user("e@x.org", "Ed", "h")
    assert sorted(r.id for r in s.users().collect()) == sorted([one, two, *done, new]) and len({one, two, *done, new}) == 4


def test_snapshots_and_ids(spark, filled):
    s, one, two = filled
    at = s.snapshot()
    assert s.delete_user(two) and not s.delete_user(two) and not s.delete_document("e0", two)
    s.compact()
    assert sorted(r.id for r in s.documents(at).collect()) == ["d0", "d1", "e0"] and sorted(r.id for r in s.documents().collect()) == ["d0", "d1"]
    assert s.snapshot(0).version == 0 and s.users(s.snapshot(0)).isEmpty()
    assert s.add_user("n@x.org", "New", "h") == two + 1  # ids of users who are gone are not given again
    s.init()
    assert s.count_documents(one) == 2 and s.document("d0", one).count() == 1


def test_files_without_a_commit_count_for_nothing(spark, filled):
    s, one, _ = filled
    before = state(s)
    s._written("documents", documents(spark, [(one, "lost")]).withColumn("created_at", F.current_timestamp()))
    assert state(s) == before
