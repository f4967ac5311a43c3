from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ledger

SCHEMA = "record_id long, text string, meta string, seen_at timestamp"
ROWS = [
    (1, "One two.", '{"a": "X y", "n": 3}'), (2, "one  TWO", '{"n": "3", "a": "x Y."}'), (3, "one-two!", '{"n":3,"a":"x, y"}'),
    (4, "one two", None), (5, "ONE TWO", None), (6, "one two", '{"a": "x y"}'), (7, "two one", '{"a": "X y", "n": 3}'), (8, None, None), (9, "", None), (10, " \n\t", None),
    (11, "…", "{}"), (12, "!!", "{}"), (13, "one two", "not json"), (14, "one two", "NOT json!"), (15, "one two", '{"a": 1.50}'), (16, "one two", '{"a": 1.5}'), (17, "One -LRB-two-RRB-", None),
]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_copies(spark, batches):
    df = spark.createDataFrame([(*r, None) for r in ROWS], SCHEMA).withColumn("seen_at", F.when(F.col("record_id") % 3 > 0, F.timestamp_seconds(F.col("record_id") * 1000))).withColumn("h1", F.lit("clash")).withColumn("batch", F.lit("x"))
    keys, book, found = ledger.copies(df, batches=batches)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (4, 5), (4, 17), (11, 12), (13, 14)]
    counts = {r.first_id: r.copies for r in book.read().collect()}
    assert counts == {1: 3, 4: 3, 6: 1, 7: 1, 11: 2, 13: 2, 15: 1, 16: 1}


def test_incremental_adds_and_keeps_the_earliest(spark):
    book = ledger.Ledger(spark, buckets=4)
    b = lambda *rows: spark.createDataFrame(list(rows), ledger.KEYS)
    book.add(b((5, 1, 1), (6, 2, 2), (6, 2, 2)))
    before = dict(book.at)
    book.add(b((3, 1, 1), (9, 1, 1)))
    assert sorted(map(tuple, book.read().collect())) == [(1, 1, 3, 3), (2, 2, 2, 6)]
    assert book.at[2] == before[2] and book.at[1] != before[1]  # the other bucket was not touched
    book.add(b())
    assert book.read().count() == 2
    book.add(b((1, -7, 0)))
    assert book.read().count() == 3


def test_another_session_goes_on(spark, tmp_path):
    """A second session opens the folder; a batch that fails leaves it as it was and can be sent
    again; a batch that was counted isn't counted twice; only the batch's buckets are read and written."""
    b = lambda *rows: spark.createDataFrame(list(rows), ledger.KEYS)
    path = f"file://{tmp_path}/book"
    one = ledger.Ledger(spark, path, buckets=8, share=10)
    one.add(b(*((k, k % 8, k) for k in range(40))), "first")
    two = ledger.Ledger(spark.newSession(), path, buckets=99, share=10)
    assert two.buckets == 8 and two.version == one.version
    before, version = two.at, two.version

    def fails(batches):
        for batch in batches:
            yield batch
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        two.add(b((100, 3, 3)).mapInArrow(fails, ledger.KEYS), "second")
    assert ledger.Ledger(spark, path).at == before and ledger.Ledger(spark, path).version == version
    two.add(b((100, 3, 3), (101, 3, 3)), "second")
    two.add(b((100, 3, 3), (101, 3, 3)), "second")
    three = ledger.Ledger(spark, path)
    assert [k for k in range(8) if three.at[k] != before[k]] == [3] and three.batches == ["first", "second"]
    assert all("/bucket=3/" in f for f in three._read(three.young, [3]).inputFiles())
    got = {r.h2: (r.copies, r.first_id) for r in three.read().collect()}
    assert got == {k: (1, k) for k in range(40)} | {3: (3, 3)}
    three.compact()
    assert {r.h2: (r.copies, r.first_id) for r in ledger.Ledger(spark, path).read().collect()} == got and not three.young
    three.add(b((200, 5, 5)))
    kept = {x.name for x in (tmp_path / "book").iterdir() if x.name.startswith("part-")}
    named = {f for own in (*three.at.values(), *before.values()) for f in own if f}
    assert {f for own in three.at.values() for f in own if f} <= kept and len(kept) <= 4 and named


def test_half_written_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/book"
    one = ledger.Ledger(spark, path, buckets=2)
    one.add(spark.createDataFrame([(5, 1, 1)], ledger.KEYS))
    (tmp_path / "book" / f"manifest-{one.version + 1}.json").write_text('{"buckets": 2, "ro')
    two = ledger.Ledger(spark, path)
    assert two.version == one.version
    two.add(spark.createDataFrame([(4, 1, 1)], ledger.KEYS))
    assert [tuple(r) for r in ledger.Ledger(spark, path).read().collect()] == [(1, 1, 2, 4)]


def test_hot_content_and_empty(spark):
    hot = spark.range(300).selectExpr("id record_id", "if(id < 200, 'Same text', concat('text ', id)) text", "cast(null as string) meta", "cast(null as timestamp) seen_at")
    found = ledger.copies(hot)[2].collect()
    assert len(found) == 199 and {r.record_id for r in found} == {0}
    assert ledger.copies(hot.limit(0))[2].collect() == []
