"""The position store with several writers."""

import datetime as dt

from textpace.sources.sinks import PositionStore

AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SAVED = "user_id BIGINT, doc_id BIGINT, word_idx INT, ts TIMESTAMP"


def rows(spark, *found):
    return spark.createDataFrame([(u, d, i, AT + dt.timedelta(minutes=m)) for u, d, i, m in found], SAVED)


def current(store):
    return sorted((r.user_id, r.doc_id, r.word_idx) for r in store.current().collect())


def test_save_during_a_compaction_stays(spark, tmp_path):
    one, two = (PositionStore(spark, str(tmp_path / "p")) for _ in range(2))
    one.save(rows(spark, (1, 1, 5, 0), (2, 1, 6, 0)))
    one.save(rows(spark, (1, 1, 7, 1)))
    write = one._write

    def meanwhile(df):
        name = write(df)
        two.save(rows(spark, (1, 1, 9, 2), (3, 1, 1, 0)))
        two.clear(rows(spark, (2, 1, None, 3)))
        return name

    one._write = meanwhile
    assert one.compact()
    assert current(one) == current(two) == [(1, 1, 9), (3, 1, 1)]
    assert len(one.manifest.latest()[1]) == 3
    # A save that is older than the clear loses, also after a compaction.
    one._write = write
    assert one.compact()
    two.save(rows(spark, (2, 1, 4, 1)))
    assert current(one) == [(1, 1, 9), (3, 1, 1)]


def test_later_of_two_compactions_gives_up(spark, tmp_path):
    one, two = (PositionStore(spark, str(tmp_path / "p")) for _ in range(2))
    one.save(rows(spark, (1, 1, 5, 0)))
    write = one._write

    def meanwhile(df):
        name = write(df)
        assert two.compact()
        two.save(rows(spark, (1, 2, 3, 0)))
        return name

    one._write = meanwhile
    assert not one.compact()
    assert current(one) == [(1, 1, 5), (1, 2, 3)]


def test_number_that_another_writer_took(spark, tmp_path):
    one, two = (PositionStore(spark, str(tmp_path / "p")) for _ in range(2))
    latest, seen = one.manifest.latest, []

    def stale():
        found = latest()
        if not seen:
            seen.append(1)
            two.save(rows(spark, (2, 2, 2, 0)))
        return found

    one.manifest.latest = stale
    one.save(rows(spark, (1, 1, 1, 0)))
    assert current(two) == [(1, 1, 1), (2, 2, 2)]
    two.clear_all()
    assert current(one) == []


def test_readers_touch_few_folders(spark, tmp_path):
    store = PositionStore(spark, str(tmp_path / "p"))
    store.MOST = 3
    for i in range(9):
        store.save(rows(spark, (i % 2, 1, i, i)))
        assert len(store.manifest.latest()[1]) <= 3
    assert current(store) == [(0, 1, 8), (1, 1, 7)]
    assert current(PositionStore(spark, str(tmp_path / "none"))) == []
