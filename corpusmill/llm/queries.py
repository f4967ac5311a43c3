"""Queries pN_... over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, leaks, ledger, near_dup, packing, quality, residue


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_groups(_t(spark, sf, "documents"), threshold=0.7)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.copies(_t(spark, sf, "records"))[2]


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Each content once, by its smallest id, with the number of its copies."""
    return ledger.copies(_t(spark, sf, "records"))[1].read().select(F.col("first_id").alias("record_id"), "copies")


def p3_types(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_types(_t(spark, sf, "documents"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_types(spark, sf).where("text_type = 'not_prose'").select("doc_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_t(spark, sf, "documents"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_t(spark, sf, "documents"), _t(spark, sf, "pack_limits"))


def p7_residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_t(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_residue(spark, sf).where("coverage > 0").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_counts, p3_found, p3_types, p4_found, p5_ids, p6_containers, p7_found, p7_residue)
}

_TEXT = "{0}"
for _escape, _mark in (("-LRB-", "("), ("-RRB-", ")"), ("-LCB-", "{{"), ("-RCB-", "}}"), ("-LSB-", "["), ("-RSB-", "]")):
    _TEXT = f"replace({_TEXT}, '{_escape}', '{_mark}')"


def words_sql(column: str) -> str:
    """The words of a text, as DuckDB lists them."""
    return "regexp_extract_all(lower(" + _TEXT.format(f"nfc_normalize(coalesce({column}, ''))") + r"), '[\p{L}\p{N}]+')"


SQL = {
    "p1_found": rf"""
with recursive w as (select doc_id, {words_sql("text")} ws from documents where doc_id is not null),
g as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from w where len(ws) >= 50)),
n as (select doc_id, count(*) n from g group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.7 * (x.n + y.n - c)),
s as (select a, b from e union all select b, a from e),
r as (select a node, a root from s union select s.b, r.root from r join s on s.a = r.node)
select min(root) first_id, node doc_id from r group by node having min(root) <> node""",
    "p2_found": rf"""
with k as (
  select record_id, {words_sql("text")} ws,
    case when meta is null then null else list_sort(list_transform(json_keys(meta), lambda f: f || chr(1) || array_to_string({words_sql("json_extract_string(meta, '$.' || f)")}, ' '))) end fields
  from records where text is not null and trim(regexp_replace(text, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g')) <> ''),
g as (select record_id, min(record_id) over (partition by array_to_string(ws, ' '), fields) low from k)
select low record_id, record_id copy_id from g where low <> record_id""",
    "p4_found": rf"""
with i as (select item_id, unnest([{words_sql("passage")}, {words_sql("question")}], max_depth := 1) ws from eval_items),
q as (select distinct item_id, array_to_string(ws[k:k + 12], ' ') gram from (select item_id, ws, unnest(range(1, len(ws) - 11)) k from i where len(ws) >= 13)),
d as (select doc_id, {words_sql("text")} ws from documents),
g as (select distinct doc_id, array_to_string(ws[k:k + 12], ' ') gram from (select doc_id, ws, unnest(range(1, len(ws) - 11)) k from d where len(ws) >= 13))
select distinct item_id, doc_id from q join g using (gram)""",
}
SQL["p2_counts"] = SQL["p2_found"].replace("select low record_id, record_id copy_id from g where low <> record_id", "select low record_id, count(*) copies from g group by low")
