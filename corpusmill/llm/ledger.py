"""Copies hidden by formatting: a ledger of canonical keys, kept up batch by batch.

Method: the ledger is a table (bucket, h1, h2, copies, first_id) in Parquet folders by bucket. A
batch is aggregated to its own keys, joined by a full outer join with the ledger's matching
buckets, counts are added and the earliest representative stays; only those buckets are written
anew, and only the young part of them: each bucket has a young and an old part, and the young ones
are joined into the old when they have grown to a share of them. So a batch costs what came in
lately, not what the ledger holds. A manifest in the ledger's folder names the parts of every
bucket: any session can open the ledger, and a batch counts when its manifest is written, or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.words import sequence_hash, words
from corpusmill.session import drop, filesystem, materialize, shared_dir, temporary

KEYS = "id bigint, h1 bigint, h2 bigint"


def meta_key(meta: str | None) -> list[str]:
    """Canonical form of a JSON object: names in order, each with the words of its value. Numbers
    keep their digits as written. Null has a form of its own; what isn't an object is read as words."""
    if meta is None:
        return ["\x00null"]
    try:
        value = json.loads(meta, parse_int=str, parse_float=str, parse_constant=str)
    except (ValueError, RecursionError):
        value = meta
    if not isinstance(value, dict):
        return ["\x00other", *words(value if isinstance(value, str) else json.dumps(value))]
    out = ["\x00object"]
    for name in sorted(value):
        v = value[name]
        out += ["\x01" + name, *words(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))]
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, h1, h2 = [], [], []
        for key, text, meta in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if key is None or text is None or not text.strip():
                continue
            a, b = sequence_hash([*words(text), *meta_key(meta)])
            ids.append(key), h1.append(a), h2.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, h1, h2)], ["id", "h1", "h2"])


def canonical_keys(records: DataFrame, id: str = "record_id", text: str = "text", meta: str = "meta") -> DataFrame:
    """(id, h1, h2): 128 bits of each record's canonical form. Records of null, empty or blank text,
    and null ids, have none. Two records have the same key when their texts have the same words in
    the same order and their metas the same fields with values of the same words."""
    return records.select(F.col(id).cast("bigint"), text, meta).mapInArrow(_keyed, KEYS)


ROWS = "h1 bigint, h2 bigint, copies bigint, first_id bigint"


class Ledger:
    """Counts and first ids by canonical key, in a folder that any session can open.

    buckets: of a new ledger; fixed then. Choose it so that a bucket's rows suit a few tasks (about
    1e7). young, old: the folder of each bucket's part. share: the young part's rows over the old
    one's from which they are joined. Versions are never changed once written: a batch that fails
    leaves the ledger as it was, and what it wrote is removed by the next one that succeeds. Folders
    that neither this version nor the one before names are removed. One writer at a time: of two
    that commit the same version, the second fails."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32, share: float = 0.25):
        self.spark, self.share = spark, share
        self.path = path or temporary(spark, f"{shared_dir(spark)}/corpusmill/ledger-{uuid.uuid4().hex}")
        self.version, self.buckets, self.rows, self.batches = 0, buckets, [0, 0], []
        self.young: dict[int, str] = {}
        self.old: dict[int, str] = {}
        self.kept: set[str] = set()
        for version in sorted(self._versions(), reverse=True):
            if self._open(version):
                break

    # ---- the manifest

    def _versions(self) -> list[int]:
        fs, p = filesystem(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def _open(self, version: int) -> bool:
        """Take over a version; False if its manifest was not written to the end."""
        text = self.spark.read.text(f"{self.path}/manifest-{version}.json", wholetext=True).first()
        try:
            own = json.loads(text[0]) if text else None
        except ValueError:
            own = None
        if not own or not own.get("whole"):
            return False
        self.version, self.buckets, self.rows, self.batches = version, own["buckets"], own["rows"], own["batches"]
        self.young, self.old = ({int(k): v for k, v in own[part].items()} for part in ("young", "old"))
        return True

    def _commit(self, young: dict[int, str], old: dict[int, str], rows: list[int], batches: list[str]) -> None:
        version = max([self.version, *self._versions()]) + 1
        own = {"buckets": self.buckets, "rows": rows, "batches": batches, "young": young, "old": old, "whole": True}
        fs, p = filesystem(self.spark, f"{self.path}/manifest-{version}.json")
        out = fs.create(p, False)  # an error if another writer was here
        out.write(bytearray(json.dumps(own).encode()))
        out.close()
        before = set(self.young.values()) | set(self.old.values())
        self.version, self.young, self.old, self.rows, self.batches = version, young, old, rows, batches
        current = set(young.values()) | set(old.values())
        fs, p = filesystem(self.spark, self.path)
        for x in fs.listStatus(p):
            name = x.getPath().getName()
            if name.startswith("part-") and name not in current | before or name.startswith("manifest-") and int(name[9:-5]) < version - 1:
                fs.delete(x.getPath(), True)

    # ---- parts

    def _read(self, part: dict[int, str], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{part[b]}/bucket={b}" for b in (part if buckets is None else buckets) if b in part]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def _joined(self, one: DataFrame, two: DataFrame) -> DataFrame:
        """Counts of both added, and the earlier representative."""
        b = two.toDF("h1", "h2", "n", "low")
        return one.join(b, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("first_id", "low").alias("first_id"))

    def _write(self, rows: DataFrame) -> str:
        """A bucket's rows go to one task, so that it is one file a version."""
        name = f"part-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def _bucket(self):
        return F.pmod("h1", F.lit(self.buckets)).cast("int")

    @property
    def at(self) -> dict[int, tuple[str | None, str | None]]:
        """The folders of each bucket's old and young part."""
        return {b: (self.old.get(b), self.young.get(b)) for b in sorted(self.old | self.young)}

    def read(self) -> DataFrame:
        """(h1, h2, copies, first_id), one row a key."""
        return self._joined(self._read(self.old), self._read(self.young)) if self.young and self.old else self._read(self.young or self.old)

    def add(self, keys: DataFrame, name: str | None = None) -> None:
        """Count a batch of (id, h1, h2). A batch without rows changes nothing; a row that occurs
        twice counts twice. A batch whose name was counted already is left out, so that a batch can
        be sent again when it isn't known whether it was counted. (Names are kept in the manifest.)"""
        if name is not None and name in self.batches:
            return
        new = materialize(keys.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")), "batch")
        touched = sorted(r[0] for r in new.select(self._bucket()).distinct().collect())  # at most `buckets` rows
        if touched:
            part = self._write(self._joined(self._read(self.young, touched), new))
            young = self.young | {b: part for b in touched}
            self._commit(young, self.old, [self._read(young).count(), self.rows[1]], self.batches + ([name] if name is not None else []))
        drop(new)
        if self.rows[0] > self.share * self.rows[1]:
            self.compact()

    def compact(self) -> None:
        """Join the young parts into the old ones of the same buckets."""
        if not self.young:
            return
        same = sorted(b for b in self.young if b in self.old)
        old = self.old | self.young  # a bucket without an old part just grows old
        if same:
            part = self._write(self._joined(self._read(self.old, same), self._read(self.young, same)))
            old |= {b: part for b in same}
        self._commit({}, old, [0, self._read(old).count()], self.batches)


def arrivals(records: DataFrame, seen: str, batches: int) -> DataFrame:
    """records with a column `batch`: equal spans of arrival time, late and null times in the last."""
    low, high = records.agg(F.min(F.unix_micros(seen)), F.max(F.unix_micros(seen))).first()
    if low is None:
        return records.withColumn("batch", F.lit(batches - 1))
    step = (high - low) // batches + 1
    return records.withColumn("batch", F.coalesce(((F.unix_micros(seen) - F.lit(low)) / F.lit(step)).cast("int"), F.lit(batches - 1)))


def copies(records: DataFrame, id: str = "record_id", text: str = "text", meta: str = "meta", seen: str = "seen_at", batches: int = 2) -> tuple[DataFrame, Ledger, DataFrame]:
    """The keys of all records, and the ledger after their batches; (record_id, copy_id) of each copy
    but the smallest. Records whose text is null, empty or blank are left out; extra columns are
    ignored; an empty table gives no rows. A content of any number of copies is one row of the
    ledger; the keys of its copies are split over tasks by AQE when they are joined with it."""
    timed = arrivals(records.select(id, text, meta, seen), seen, batches)
    keys = materialize(timed.select(F.col(id).cast("bigint").alias("id"), text, meta, "batch").mapInArrow(_keyed_batch, KEYS + ", batch int"), "keys")
    ledger = Ledger(records.sparkSession)
    for k in range(batches):
        ledger.add(keys.where(F.col("batch") == k).select("id", "h1", "h2"), f"arrivals-{k}")
    several = ledger.read().where("copies > 1")
    found = keys.select("id", "h1", "h2").join(several, ["h1", "h2"]).where("id <> first_id").select(F.col("first_id").alias("record_id"), F.col("id").alias("copy_id"))
    return keys, ledger, found


def _keyed_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [x is not None and t is not None and bool(t.strip()) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        for out in _keyed(iter([batch.select([0, 1, 2])])):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(3).filter(pa.array(own, pa.bool_()))], ["id", "h1", "h2", "batch"])
