"""The nearest historical texts: what they cost where texts of a template meet, and what they are."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill.plans import QUERIES, SQL
from tests.conftest import rows_of, sql_rows


def shuffled(spark) -> int:
    """Records that all stages so far have written for others to read."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    """200 pages of one template on either side, all different and similar to all others; copies, texts that repeat themselves, short and empty ones."""
    draw = random.Random(1)
    frame = [f"w{k}" for k in range(90)]

    def page() -> str:
        words = list(frame)
        for _ in range(draw.randrange(2, 7)):
            words[draw.randrange(90)] = f"v{draw.randrange(40)}"
        return " ".join(words[: draw.randrange(60, 91)])

    texts = [page() for _ in range(400)]
    texts += texts[:3] + texts[200:203] + ["", " ", "w1 w2 w3 w4", "w1 w2 w3 w4 w5 w6", "w1 w2 w3 w4 w5 w6", "a b c " * 30, "c a b " * 20, "quite another text of more than five words", None]
    where = [f"crawl-shard-0{30 if k < 200 else 10}" for k in range(400)] + ["crawl-shard-011"] * 3 + ["crawl-shard-031"] * 3 + ["crawl-shard-030", "crawl-shard-001"] * 4 + ["crawl-shard-030"]
    where[5] = where[205] = None
    ids = draw.sample(range(10_000), len(texts))
    rows = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": where, "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "source_row": pa.array(range(len(ids)), pa.int32()), "topic": ["x"] * len(ids), "text_sha": ["x"] * len(ids), "fetched_at": pa.array([0] * len(ids), pa.timestamp("us", "UTC"))}
    folder = tmp_path_factory.mktemp("pages")
    pq.write_table(pa.table(rows), folder / "documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["nearest_ref", "threshold_table", "overlap_review"])
def test_pairs_of_a_template_are_not_shuffled(name, spark, pages):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{pages}/documents.parquet')")
    before = shuffled(spark)
    got = rows_of(QUERIES[name](spark, str(pages)))
    assert shuffled(spark) - before < 20_000  # 40,000 pairs share runs
    assert got == sql_rows(con, SQL[name])[1]


def test_lists_that_are_cut_give_the_same(monkeypatch):
    from corpusmill.operators import nearest as N

    draw = np.random.default_rng(2)

    def texts(first: int, count: int) -> N._Texts:
        sizes = draw.integers(1, 60, count)
        steps = np.concatenate([np.concatenate([[draw.integers(5)], draw.choice([1, 1, 1, 1, 1, 1, 1, 1, 2], k - 1)]) for k in sizes])
        begin = np.repeat(draw.integers(0, 30, count), sizes)
        at = begin + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hashes, at = np.unique(at * 7 + 1, return_inverse=True)
        return N._Texts(N._bytes(np.arange(first, first + count), 8), N._bytes(sizes), N._bytes(sizes + 30), N._bytes(sizes), N._bytes(steps), N._bytes(hashes, 8), N._bytes(at))

    a, b = texts(0, 30), texts(100, 41)
    found = []
    for rows in (10**6, 100):
        monkeypatch.setattr(N, "_ROWS", rows)
        best = N._Best(a)
        N._met(a, b, best)
        found.append(best)
    assert (found[0].value > 0).any(axis=1).all() and found[0].met.any()
    for kind in ("value", "source", "met"):
        assert (getattr(found[0], kind) == getattr(found[1], kind)).all()


def test_keys_are_read_as_they_were_coded():
    from corpusmill.operators import nearest as N

    draw = np.random.default_rng(3)
    for count, bits in ((1, 8), (3, 8), (256, 8), (1000, 20), (5000, 13)):
        keys = np.sort(draw.choice(1 << bits, count, replace=False)).astype(np.uint64)
        assert (N._decoded(N._coded(keys, bits), count, bits) == keys.astype(np.int64)).all()
