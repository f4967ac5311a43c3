"""Queries that run as streams of what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.plans import sql as Q
from corpusmill.plans.registry import docs, query
from corpusmill.session import shared_dir, temporary
from corpusmill.sources.files import SCHEMAS
from corpusmill.streaming import incremental

TARGET = 1 << 60


@query(f"select {Q.content_key('text')} as key, min(doc_id) id from documents where text is not null group by 1")
def incremental_select(spark, sf):
    """First document of each content, accepted file by file."""
    return incremental.run(spark, f"{sf}/documents.parquet", SCHEMAS["documents"], "doc_id", "text", {0: TARGET, 1: TARGET, 2: TARGET}).select("key", "id")


#: Characters that each split may take, for the table that arrives in several files.
BUDGETS = {0: 200_000, 1: 4_000, 2: 4_000}
FILES = 4


@query(f"""with k as (select {Q.content_key('text')} as key, min(doc_id) id from documents where text is not null group by 1), u as (select k.key, id, length(text)::bigint size, case ('0x' || k.key[14:16])::int % 16 when 0 then 1 when 1 then 2 else 0 end split from k join documents d on d.doc_id = k.id),
r as (select *, sum(size) over (partition by split order by id)::bigint - size before from u) select key, id, split from r where before < case split when 0 then {BUDGETS[0]} else {BUDGETS[1]} end""")
def incremental_budget(spark, sf):
    """First document of each content under budgets of characters, from files that come one after the other: every
    batch goes on where the ones before have ended."""
    path = temporary(spark, f"{shared_dir(spark)}/corpusmill/arriving-{uuid.uuid4().hex}")
    d = docs(spark, sf).select("doc_id", "text")
    low, high = d.agg(F.min("doc_id"), F.max("doc_id")).first()
    for k in range(FILES if low is not None else 0):  # in the order of ids, which is that of arrival
        first, last = (low + (high - low + 1) * j // FILES for j in (k, k + 1))
        d.where((F.col("doc_id") >= first) & (F.col("doc_id") < last)).coalesce(1).write.mode("append").parquet(path)
    return incremental.run(spark, path, "doc_id bigint, text string", "doc_id", "text", BUDGETS, buckets=16).select("key", "id", "split")
