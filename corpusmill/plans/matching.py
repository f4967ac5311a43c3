"""Matching, deduplication and groups over documents, records and evaluation items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import dedup, nearest, ordered, similarity as S
from corpusmill.operators.graph import connected_components
from corpusmill.plans import sql as Q
from corpusmill.plans.registry import docs, query, table
from corpusmill.session import materialize, spread

RES = "source >= 'crawl-shard-030'"
#: Documents that make a run a template, at least, of the reserved ones and of all; 100 on large tables, fewer
#: here, where the small ones have some.
FLOOR, ALL_FLOOR = 3, 5


def reserved() -> Column:
    """The shards from 030 on are the reserved ones, the others historical."""
    return F.col("source") >= "crawl-shard-030"


def held() -> Column:
    return F.col("source_shard") >= "crawl-shard-030"


def worded(spark: SparkSession, sf: str) -> DataFrame:
    """(id, source, words) of documents with a text."""
    return spread(docs(spark, sf)).where("text is not null").select(F.col("doc_id").alias("id"), "source", X.tokens(F.col("text")).alias("words"))


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(id, source, body, key, reserved): each document's matching text and a SHA-256 of it, written once.
    As text it is a third of what its words are as an array."""
    w = worded(spark, sf).select("id", "source", F.array_join("words", " ").alias("body"))
    return materialize(w.withColumns({"key": F.sha2("body", 256), "reserved": reserved()}), "bodies")


def split_words(b: DataFrame) -> DataFrame:
    """b with the words of its bodies."""
    return b.withColumn("words", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", " ")))


def representatives(b: DataFrame, *by: str) -> DataFrame:
    """The rows of the smallest id of each content, within `by`, with their words."""
    low = b.groupBy(*by, "key").agg(F.min("id").alias("id"))
    return split_words(b.join(low.select("id"), "id", "left_semi"))


def blocks(b: DataFrame, *by: str) -> DataFrame:
    """(id, body, side, block): the rows of the smallest id of each content, within `by`, written once in
    blocks of as much as a task wrote; side is 1 for the historical ones where `by` tells them apart."""
    low = b.groupBy(*by, "key").agg(F.min("id").alias("id"))
    side = F.when(F.col("reserved"), 0).otherwise(1) if by else F.lit(0)
    return materialize(b.join(low.select("id"), "id", "left_semi").select("id", "body", side.cast("int").alias("side"), F.spark_partition_id().alias("block")), "contents")


def memberships(b: DataFrame, *by: str) -> DataFrame:
    """(id, class_id) of every row, within `by`."""
    low = b.groupBy(*by, "key").agg(F.min("id").alias("class_id"))
    return b.select("id", *by, "key").join(low, [*by, "key"]).select("id", "class_id")


@query(f"select doc_id, source, source_row, {Q.content_key('text')} text_key from documents where text is not null qualify row_number() over (partition by {Q.content_key('text')} order by source, source_row, doc_id) = 1")
def exact_dedup(spark, sf):
    """The first document of each content, in the order of shard and row."""
    keyed = docs(spark, sf).where("text is not null").select("doc_id", "source", "source_row", X.content_key(F.col("text")).alias("text_key"))
    return dedup.first_of(keyed, ["text_key"], "source", "source_row", "doc_id")


@query("select record_id, token_sha, min(record_id) over w as keep_id, count(*) over w as copies, case when record_id > min(record_id) over w then min(record_id) over w end duplicate_of from records where token_sha is not null window w as (partition by token_sha)")
def dedup_audit(spark, sf):
    """Removals by token hash, with the id that is kept."""
    rows = dedup.marked(table(spark, sf, "records").where("token_sha is not null").select("record_id", "token_sha"), ["token_sha"], "record_id")
    return rows.select("record_id", "token_sha", F.coalesce("duplicate_of", "record_id").alias("keep_id"), "copies", "duplicate_of")


@query("select token_sha, count(*) copies, min(record_id) first_id, max(record_id) last_id, count(distinct source_shard) shards from records where token_sha is not null group by token_sha having count(*) > 1")
def dup_groups(spark, sf):
    return table(spark, sf, "records").where("token_sha is not null").groupBy("token_sha").agg(F.count("*").alias("copies"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"), F.countDistinct("source_shard").alias("shards")).where("copies > 1")


@query(f"""
with p as (select source, {Q.content_key('text')} k, unnest(case when {RES} then ['all', 'reserved'] else ['all', 'historical'] end) profile from documents where text is not null),
c as (select profile, k, count(*) n, count(distinct source) shards from p group by 1, 2)
select profile, sum(n)::bigint documents, count(*) unique_contents, sum(n - 1)::bigint extra_copies, count_if(n = 1)::bigint singletons, count_if(shards > 1)::bigint cross_shard, max(n) most_copies, round(100.0 * count(*) / sum(n), 6) unique_percent from c group by 1""")
def dup_census(spark, sf):
    keyed = docs(spark, sf).where("text is not null").select("source", X.content_key(F.col("text")).alias("k"))
    return dedup.census(keyed, "k", "source", {"all": F.lit(True), "reserved": reserved(), "historical": ~reserved()})


@query(f"with c as (select {Q.content_key('text')} k, count(*) copies from documents where text is not null group by 1) select copies, count(*) contents from c group by 1")
def copy_histogram(spark, sf):
    """Contents by their number of copies."""
    return dedup.copy_histogram(docs(spark, sf).where("text is not null").select(X.content_key(F.col("text")).alias("k")), "k")


@query("""
with s as (select token_sha, source_shard, count(*) n from records where token_sha is not null group by 1, 2), c as (select token_sha, sum(n) n, count(*) shards from s group by 1)
select sum(n)::bigint documents, count(*) unique_contents, (select sum(n - 1)::bigint from s) within_shard, (sum(n - 1) - (select sum(n - 1) from s))::bigint across_shards from c""")
def shard_copies(spark, sf):
    """Extra copies within a shard and across shards."""
    s = table(spark, sf, "records").where("token_sha is not null").groupBy("token_sha", "source_shard").agg(F.count("*").alias("n"))
    c = s.groupBy("token_sha").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("inside"))
    return c.agg(F.sum("n").alias("documents"), F.count("*").alias("unique_contents"), F.sum("inside").alias("within_shard"), F.sum(F.col("n") - 1 - F.col("inside")).alias("across_shards"))


@query("""
with k as (select token_sha, count_if(source_shard < 'crawl-shard-030')::bigint train, count_if(source_shard >= 'crawl-shard-030')::bigint held from records where token_sha is not null group by 1)
select sum(train)::bigint train_rows, sum(held)::bigint held_rows, count_if(train > 0 and held > 0)::bigint shared_contents, coalesce(sum(case when held > 0 then train end), 0)::bigint train_rows_shared, coalesce(sum(case when train > 0 then held end), 0)::bigint held_rows_shared from k""")
def overlap_counts(spark, sf):
    k = table(spark, sf, "records").where("token_sha is not null").groupBy("token_sha").agg(F.count_if(~held()).alias("train"), F.count_if(held()).alias("held"))
    return k.agg(
        F.sum("train").alias("train_rows"), F.sum("held").alias("held_rows"), F.count_if((F.col("train") > 0) & (F.col("held") > 0)).alias("shared_contents"),
        F.coalesce(F.sum(F.when(F.col("held") > 0, F.col("train"))), F.lit(0)).alias("train_rows_shared"), F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("held"))), F.lit(0)).alias("held_rows_shared"),
    )


@query(r"""
with l as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null), e as (select doc_id, unnest(ls) line, unnest(range(len(ls))) i from l), f as (select doc_id, line, min(i) i from e group by 1, 2)
select l.doc_id, any_value(len(l.ls)) lines, count(*) kept, string_agg(line, chr(10) order by i) as text from f join l using (doc_id) group by l.doc_id""")
def line_dedup(spark, sf):
    """Each document with repeated lines removed."""
    return dedup.unique_lines(docs(spark, sf), "doc_id", "text")


_HELD = "t as (select record_id, source_shard, token_sha, text, (source_shard >= 'crawl-shard-030') held from records where text is not null and token_sha is not null)"


def _contents(spark, sf):
    """Contents of records by token hash, length and the text itself, with the train rows' number and first id."""
    t = table(spark, sf, "records").where("text is not null and token_sha is not null").select("record_id", "source_shard", "token_sha", held().alias("held"), F.length("text").alias("n"), "text")
    train = t.where("not held").groupBy("token_sha", "n", "text").agg(F.count("*").alias("train_rows"), F.min("record_id").alias("first_train"))
    return t, train


@query(f"with {_HELD} select token_sha, count_if(held)::bigint held_rows, count_if(not held)::bigint train_rows, min(case when held then record_id end) first_held, min(case when not held then record_id end) first_train from t group by token_sha, text having count_if(held) > 0 and count_if(not held) > 0")
def exact_overlap(spark, sf):
    """Contents that held-out and train records share, one row each: equal by hash and by the text itself."""
    t, train = _contents(spark, sf)
    own = t.where("held").groupBy("token_sha", "n", "text").agg(F.count("*").alias("held_rows"), F.min("record_id").alias("first_held"))
    return own.join(train, ["token_sha", "n", "text"]).select("token_sha", "held_rows", "train_rows", "first_held", "first_train")


@query(f"with {_HELD} select h.record_id held_id, count(*) train_copies, min(r.record_id) first_train, count_if(r.source_shard = h.source_shard)::bigint same_shard from t h join t r on r.token_sha = h.token_sha and r.text = h.text and not r.held where h.held group by 1")
def exact_overlap_members(spark, sf):
    """Held-out records with their exact train copies: how many, the first, and how many of the same shard."""
    t, train = _contents(spark, sf)
    shards = t.where("not held").groupBy("token_sha", "n", "text", "source_shard").agg(F.count("*").alias("same"))
    rows = t.where("held").join(train, ["token_sha", "n", "text"]).join(shards, ["token_sha", "n", "text", "source_shard"], "left")
    return rows.select(F.col("record_id").alias("held_id"), F.col("train_rows").alias("train_copies"), "first_train", F.coalesce("same", F.lit(0)).alias("same_shard"))


@query(f"with {_HELD}, m as (select h.record_id, count(*) copies from t h join t r on r.token_sha = h.token_sha and r.text = h.text and not r.held where h.held group by 1) select copies, count(*) held_records from m group by 1")
def overlap_histogram(spark, sf):
    """Held-out records by their number of train copies."""
    return exact_overlap_members(spark, sf).groupBy(F.col("train_copies").alias("copies")).agg(F.count("*").alias("held_records"))


@query(f"with {_HELD}, m as (select distinct h.record_id from t h join t r on r.token_sha = h.token_sha and r.text = h.text and not r.held where h.held) select source_shard, count(*) held_records, count(m.record_id) matched, round(100.0 * count(m.record_id) / count(*), 6) percent from t left join m using (record_id) where held group by 1")
def overlap_by_shard(spark, sf):
    """Held-out records of each shard, and those with a train copy."""
    t, train = _contents(spark, sf)
    rows = t.where("held").join(train, ["token_sha", "n", "text"], "left")
    return rows.groupBy("source_shard").agg(F.count("*").alias("held_records"), F.count("train_rows").alias("matched"), F.round(100.0 * F.count("train_rows") / F.count("*"), 6).alias("percent"))


@query("""
with t as (select record_id, source_shard, token_sha, (source_shard >= 'crawl-shard-030')::int split from records where token_sha is not null), m as (select a.record_id held_id, a.source_shard, b.record_id train_id from t a join t b using (token_sha) where a.split > 0 and b.split = 0), c as (select held_id, source_shard, count(*) copies from m group by 1, 2)
select (select count(*) from t where split > 0) held, count(*) matched, round(100.0 * count(*) / (select count(*) from t where split > 0), 6) matched_percent, min(copies) fewest, quantile_cont(copies, 0.5)::double median, max(copies) most, count(distinct source_shard) shards from c""")
def overlap_summary(spark, sf):
    t = table(spark, sf, "records").where("token_sha is not null").select("record_id", "source_shard", "token_sha", held().cast("int").alias("split"))
    train = t.where("split = 0").groupBy("token_sha").agg(F.count("*").alias("copies"))  # one row a content: a hot one isn't multiplied
    rows = t.where("split > 0").join(train, "token_sha", "left")
    return rows.agg(F.count("*").alias("held"), F.count("copies").alias("matched"), F.round(100.0 * F.count("copies") / F.count("*"), 6).alias("matched_percent"), F.min("copies").alias("fewest"), F.percentile("copies", 0.5).alias("median"), F.max("copies").alias("most"), F.countDistinct(F.when(F.col("copies").isNotNull(), F.col("source_shard"))).alias("shards"))


@query("select record_id from records where source_shard >= 'crawl-shard-030' and lower(text_sha) in (select lower(text_sha) from records where source_shard < 'crawl-shard-030')")
def strict_semi(spark, sf):
    r = table(spark, sf, "records").select("record_id", held().cast("int").alias("split"), F.lower("text_sha").alias("k"))
    return r.where("split > 0").join(r.where("split = 0").select("k").distinct(), "k", "left_semi").select("record_id")


_KEYED = f"k as (select doc_id, source, source_row, {RES} reserved, {Q.content_key('text')} key from documents where text is not null)"


def _keyed(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", "source", "source_row", reserved().alias("reserved"), X.content_key(F.col("text")).alias("key"))


@query(f"with {_KEYED}, h as (select key, count(*) copies, arg_min(doc_id, (source, source_row)) first_id from k where not reserved group by 1) select doc_id, coalesce(copies, 0) copies, first_id from k left join h using (key) where reserved")
def historical_copies(spark, sf):
    """Reserved documents with the number of historical copies and the first one's id."""
    k = _keyed(spark, sf)
    h = k.where("not reserved").groupBy("key").agg(F.count("*").alias("copies"), F.min_by("doc_id", F.struct("source", "source_row")).alias("first_id"))
    return k.where("reserved").join(h, "key", "left").select("doc_id", F.coalesce("copies", F.lit(0)).alias("copies"), "first_id")


@query(f"with {_KEYED} select doc_id, row_number() over (order by source, source_row) - 1 candidate_id from (select * from k where reserved and key not in (select key from k where not reserved) qualify row_number() over (partition by key order by source, source_row) = 1)")
def candidates(spark, sf):
    """Reserved contents that the historical shards don't have, each once, with ids in order."""
    k = _keyed(spark, sf)
    fresh = k.where("reserved").join(k.where("not reserved").select("key").distinct(), "key", "left_anti").select("key", "source", "source_row", "doc_id")
    first = dedup.first_of(fresh, ["key"], "source", "source_row", "doc_id")
    return ordered.numbered(first, ["source", "source_row"]).select("doc_id", (F.col("rn") - 1).alias("candidate_id"))


@query(f"select a.doc_id, min(b.doc_id) reference_id from (select doc_id, {Q.body('text')} b from documents where text is not null and {RES}) a join (select doc_id, {Q.body('text')} b from documents where text is not null and not {RES}) b on a.b = b.b where a.b <> '' group by 1")
def norm_exact(spark, sf):
    """Equal normalized bodies: joined on the hash and the body itself."""
    d = docs(spark, sf).where("text is not null").select("doc_id", reserved().alias("r"), X.body(F.col("text")).alias("b")).where("b <> ''").withColumn("h", F.xxhash64("b"))
    known = d.where("not r").groupBy("h", "b").agg(F.min("doc_id").alias("reference_id"))
    return d.where("r").join(known, ["h", "b"]).select("doc_id", "reference_id")




def _docs_sql(keep: str = "") -> str:
    return f"docs as (select * from (select *, {RES} res, array_to_string(ws, ' ') body from (select doc_id, source, text, {Q.tokens('text')} ws from documents where text is not null)) {keep})"


_ALL, _REPS, _SIDES = _docs_sql(), _docs_sql("qualify min(doc_id) over (partition by body) = doc_id"), _docs_sql("qualify min(doc_id) over (partition by body, res) = doc_id")
_SETS = f"{Q.grams(5)}, s as (select distinct g.doc_id, docs.res, gram from g join docs using (doc_id)), z as (select doc_id, count(*) m from s group by 1), w as (select doc_id, len(ws) n, res from docs)"


def _pairs(where: str, name: str = "p") -> str:
    return f"{name}c as (select x.doc_id a, y.doc_id b, count(*) shared from s x join s y on x.gram = y.gram where {where} group by 1, 2), {name} as (select a, b, shared, zx.m ma, zy.m mb, wx.n na, wy.n nb from {name}c join z zx on zx.doc_id = a join z zy on zy.doc_id = b join w wx on wx.doc_id = a join w wy on wy.doc_id = b)"


_NEAR = "(shared / (ma + mb - shared) >= 0.8 or (shared / least(ma, mb) >= 0.8 and least(na, nb) >= 50 and shared >= 20))"
_ACROSS, _WITHIN = "x.res and not y.res", "x.doc_id < y.doc_id"


def _near(left: DataFrame, right: DataFrame, self_join: bool = False) -> DataFrame:
    sets = lambda d: S.gram_sets(d, "id", "words", 5)
    return S.near(S.overlap_pairs(sets(left), sets(right), 0.8, self_join, 50))


@query(f"with {_SIDES}, {_SETS}, {_pairs(_ACROSS)} select a, b, shared / (ma + mb - shared) jaccard, shared / least(ma, mb) containment from p where {_NEAR}")
def near_dup(spark, sf):
    """Reserved contents near to historical ones: pairs of the first documents of each content on its
    side; near_classes has the members."""
    b = bodies(spark, sf)
    return _near(representatives(b.where("reserved")), representatives(b.where("not reserved")))


@query(f"with {_ALL} select doc_id id, min(doc_id) over (partition by body, res) class_id, res reserved from docs")
def near_classes(spark, sf):
    """The first document of each document's content on its side."""
    b = bodies(spark, sf)
    return memberships(b, "reserved").join(b.select("id", "reserved"), "id").select("id", "class_id", "reserved")


@query(f"with {_ALL} select doc_id id, min(doc_id) over (partition by body) class_id from docs")
def content_classes(spark, sf):
    """The first document of each document's content."""
    return memberships(bodies(spark, sf))


@query(f"with {_REPS}, {_SETS}, {_pairs(_WITHIN)} select a, b, shared / (ma + mb - shared) jaccard, shared / least(ma, mb) containment from p where {_NEAR}")
def internal_edges(spark, sf):
    """Near pairs of different contents within the corpus, each once, by their first documents."""
    one = representatives(bodies(spark, sf))
    return _near(one, one, True)


def _template_sql(of: str, floor: int) -> str:
    """Runs of 13 words in many of the documents that `of` selects."""
    return f"(select gram from g13 join docs using (doc_id) where {of} group by 1 having count(distinct doc_id) >= greatest({floor}, ceil((select count(*) from docs where {of}) / 100)))"


def _partial_sql(of: str, floor: int) -> str:
    return f"""t13 as {_template_sql(of, floor)}, v as (select g13.* from g13 join w using (doc_id) where n >= 50 and gram not in (select gram from t13)),
vp as (select x.doc_id a, y.doc_id b, x.pos pa, y.pos pb from v x join v y on x.gram = y.gram where x.doc_id < y.doc_id), va as (select a, b, count(distinct place) n from (select a, b, unnest(range(pa, pa + 13)) place from vp) group by 1, 2), vb as (select a, b, count(distinct place) n from (select a, b, unnest(range(pb, pb + 13)) place from vp) group by 1, 2),
pt as (select a, b from va join vb using (a, b) join w wa on wa.doc_id = a join w wb on wb.doc_id = b where va.n / wa.n >= 0.3 or vb.n / wb.n >= 0.3)"""


_EX = f"ex as (select low a, doc_id b from (select doc_id, min(doc_id) over (partition by array_to_string({Q.tokens('text')}, ' ')) low from documents where text is not null) where low <> doc_id)"
_CONTENT = f"{_REPS}, {_SETS}, {_pairs(_WITHIN)}, {Q.grams(13, 'g13')}, {_partial_sql('true', ALL_FLOOR)}, {_EX}, ce as (select a, b, 'near' reason, shared / (ma + mb - shared) jaccard, shared / least(ma, mb) containment from p where {_NEAR} union all select a, b, 'exact', 1, 1 from ex union all select a, b, 'partial', 0, 0 from pt)"


def _edges(b: DataFrame, floor: int) -> DataFrame:
    """Exact, near and partial edges within the contents of b."""
    one = blocks(b)
    named = lambda pairs, reason, value: pairs.select("a", "b", F.lit(reason).alias("reason"), F.lit(value).alias("jaccard"), F.lit(value).alias("containment"))
    exact = memberships(b).where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    runs = S.shared_runs(one, (5, 13), (13,), True)
    near = S.near(S.overlapping(runs.where("n = 5"), 0.8, 50)).select("a", "b", F.lit("near").alias("reason"), "jaccard", "containment")
    rows = S.placed(runs.where("n = 13"))
    rows = rows.where("words_n >= 50").join(S.frequent(rows, max(floor, -(-one.count() // 100))), ["h", "i"], "left_anti")
    long = lambda k: runs.where("n = 13 and words_n >= 50").select(F.col("id").alias(k), F.col("words_n").alias(f"n{k}"))
    both = S.covered_pairs(rows, long("a"), long("b"), 13, True, 0.3)
    partial = both.where("ca / na >= 0.3 or cb / nb >= 0.3").select("a", "b")
    return near.unionByName(named(exact, "exact", 1.0)).unionByName(named(partial, "partial", 0.0))


@query(f"with {_CONTENT} select * from ce")
def content_edges(spark, sf):
    """Edges within the corpus: exact ones from each content's first document to the others, near and partial
    ones between first documents. Partial: either text's words lie for 30 % in runs of 13 that both have."""
    return _edges(bodies(spark, sf), ALL_FLOOR)


def _components_sql(edges: str) -> str:
    return f"u as (select a, b from {edges} union all select b, a from {edges}), r as (select a node, a root from u union select u.b, r.root from r join u on u.a = r.node), m as (select node, min(root) component from r group by 1)"


@query(f"with recursive {_CONTENT}, {_components_sql('ce')} select * from m")
def content_groups(spark, sf):
    """Content groups: components of the exact, near and partial edges."""
    return connected_components(content_edges(spark, sf))


_COVER = "h as (select r.doc_id, unnest(range(r.pos, r.pos + 13)) place from r where gram in (select gram from q)), c as (select doc_id, count(distinct place) covered from h group by 1)"


@query(f"with {Q.DOCS}, {Q.grams(13)}, r as (select * from g where {RES}), q as (select gram from g where not {RES}), {_COVER} select doc_id id, coalesce(covered, 0) covered, len(ws) words_n from docs left join c using (doc_id) where {RES}")
def coverage13(spark, sf):
    """Words of reserved documents inside runs of 13 words that historical documents have."""
    w = materialize(worded(spark, sf), "words")
    return S.coverage(w.where(reserved()), w.where(~reserved()), 13)


@query(f"with {Q.DOCS}, {Q.grams(13)} select gram, count(distinct doc_id) df from g where {RES} group by 1 having count(distinct doc_id) >= greatest({FLOOR}, ceil((select count(*) from docs where {RES}) / 100))")
def template_grams(spark, sf):
    """Runs of 13 words in many reserved documents (the candidates). The floor is a parameter."""
    w = materialize(worded(spark, sf).where(reserved()), "words")
    keys = S.template_keys(w, 13, FLOOR)
    rows = S.run_rows(w, "id", "words", 13).join(keys, ["h", "i"])
    first = rows.groupBy("h", "i").agg(F.min(F.struct("id", "pos")).alias("x"), F.max("df").alias("df")).select("x.*", "df")  # one place of each to read its words
    return first.join(w, "id").select(F.array_join(F.slice("words", F.col("pos"), F.lit(13)), " ").alias("gram"), "df")


@query(f"""with {Q.DOCS}, {Q.grams(13)}, t as (select gram from g where {RES} group by 1 having count(distinct doc_id) >= greatest({FLOOR}, ceil((select count(*) from docs where {RES}) / 100))), r as (select * from g where {RES} and gram not in (select gram from t)), q as (select gram from g where not {RES}), {_COVER}
select doc_id id, coalesce(covered, 0) covered, len(ws) words_n from docs left join c using (doc_id) where {RES}""")
def masked_coverage(spark, sf):
    """coverage13 without template runs."""
    return _masked(materialize(worded(spark, sf), "words"))


def _masked(w: DataFrame) -> DataFrame:
    return S.coverage(w.where(reserved()), w.where(~reserved()), 13, S.template_keys(w.where(reserved()), 13, FLOOR))


_NEAREST = f"""{_ALL}, {_SETS}, {_pairs(_ACROSS)}, {Q.grams(13, 'g13')}, o as (select a, b, shared / (ma + mb - shared) j, case when least(na, nb) >= 50 and shared >= 20 then shared / least(ma, mb) end c from p),
k as (select distinct x.doc_id a, y.doc_id b, unnest(range(x.pos, x.pos + 13)) place from g13 x join g13 y on x.gram = y.gram join docs dx on dx.doc_id = x.doc_id join docs dy on dy.doc_id = y.doc_id where dx.res and not dy.res),
cv as (select a, b, count(*) / any_value(n) v from k join w on w.doc_id = a group by 1, 2), uc as (select a, count(distinct place) / any_value(n) v from k join w on w.doc_id = a group by 1),
n1 as (select a, max(j) max_jaccard, arg_max(b, (j, -b)) jaccard_source, max(c) max_containment, arg_max(b, (c, -b)) filter (c is not null) containment_source from o group by 1), n2 as (select a, max(v) max_coverage, arg_max(b, (v, -b)) coverage_source from cv group by 1),
nr as (select doc_id id, coalesce(max_jaccard, 0) max_jaccard, jaccard_source, coalesce(max_containment, 0) max_containment, containment_source, coalesce(max_coverage, 0) max_coverage, coverage_source, coalesce(uc.v, 0) union_coverage from docs left join n1 on n1.a = doc_id left join n2 on n2.a = doc_id left join uc on uc.a = doc_id where res)"""


@query(f"with {_NEAREST} select * from nr")
def nearest_ref(spark, sf):
    """For every reserved document the best over all historical ones that share anything: similarity,
    containment (of pairs long enough), share of its words in runs of 13 that one has, each with its source
    (the smallest of equals), and the share in runs that any has. 0 and no source where there is none.
    Computed for contents and given to each member."""
    b = nearest.packed(worded(spark, sf).where("source is not null").select("id", F.when(reserved(), 0).otherwise(1).alias("side"), F.array_join("words", " ").alias("body")))
    members = materialize(nearest.contents(b).where("side = 0").select("id", "key"), "members")
    classes = members.groupBy("key").agg(F.min("id").alias("a"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    told = members.join(classes, "key").select("id", "a").join(nearest.nearest(b), "a", "left")
    return told.select("id", zero("max_jaccard"), "jaccard_source", zero("max_containment"), "containment_source", zero("max_coverage"), "coverage_source", zero("union_coverage"))


_HIT = "max_jaccard >= 0.6 or max_containment >= 0.6 or union_coverage >= 0.3"


@query(f"with {_NEAREST}, rk as (select *, row_number() over (order by max_jaccard desc, id) a, row_number() over (order by max_containment desc, id) b, row_number() over (order by union_coverage desc, id) c from nr) select id, a <= 20 by_jaccard, b <= 20 by_containment, c <= 20 by_coverage, {_HIT} over_threshold from rk where a <= 20 or b <= 20 or c <= 20 or {_HIT}")
def overlap_review(spark, sf):
    """Reserved documents to look at: the first 20 by each measure, and all over a threshold."""
    n = materialize(nearest_ref(spark, sf), "nearest")
    first = lambda c, name: n.orderBy(F.desc(c), "id").limit(20).select("id", F.lit(name).alias("why"))
    why = first("max_jaccard", "by_jaccard").union(first("max_containment", "by_containment")).union(first("union_coverage", "by_coverage")).union(n.where(_HIT).select("id", F.lit("over_threshold")))
    return why.groupBy("id").agg(*(F.bool_or(F.col("why") == w).alias(w) for w in ("by_jaccard", "by_containment", "by_coverage", "over_threshold")))


_AT = (80, 70, 60)
_TABLED = ", ".join([f"count_if(max_jaccard >= {t / 100} or max_containment >= {t / 100})::bigint near_{t}" for t in _AT] + ["count_if(union_coverage >= 0.3)::bigint coverage_30", "count_if(union_coverage > 0)::bigint any_shared", "max(max_jaccard) max_jaccard", "max(max_containment) max_containment", "max(union_coverage) max_coverage", "count(*) documents"])


@query(f"with {_NEAREST}, su as (select *, row_number() over (order by sha256(id::varchar), id) <= 100 chosen from nr) select 'all' profile, {_TABLED} from su union all select 'subset', {_TABLED} from su where chosen")
def threshold_table(spark, sf):
    """How many reserved documents reach each threshold of similarity or containment, and of coverage, and the
    greatest values: of all, and of the first 100 by hash."""
    n = materialize(nearest_ref(spark, sf), "nearest")
    some = n.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(100)
    tabled = [
        *(F.count_if((F.col("max_jaccard") >= t / 100) | (F.col("max_containment") >= t / 100)).alias(f"near_{t}") for t in _AT), F.count_if(F.col("union_coverage") >= 0.3).alias("coverage_30"), F.count_if(F.col("union_coverage") > 0).alias("any_shared"),
        F.max("max_jaccard").alias("max_jaccard"), F.max("max_containment").alias("max_containment"), F.max("union_coverage").alias("max_coverage"), F.count("*").alias("documents"),
    ]
    return n.agg(F.lit("all").alias("profile"), *tabled).unionByName(some.agg(F.lit("subset").alias("profile"), *tabled))


@query(f"with recursive {_REPS}, {_SETS}, {_pairs(_WITHIN)}, e as (select a, b from p where {_NEAR}), {_components_sql('e')} select * from m")
def components(spark, sf):
    """Components of the near pairs of contents, by their first documents."""
    return connected_components(internal_edges(spark, sf))


@query(f"""with recursive {_ALL}, {_SETS}, {_pairs(_ACROSS)}, {_pairs('x.doc_id < y.doc_id and x.res and y.res', 'pi')}, {Q.grams(13, 'g13a')}, g13 as (select g13a.* from g13a join docs using (doc_id) where res), {_partial_sql('res', FLOOR)},
e as (select a, b from pi where {_NEAR} union all select a, b from pt union all select x.doc_id, y.doc_id from docs x join docs y on x.body = y.body and x.res and y.res and x.doc_id < y.doc_id), eo as (select * from e union all select doc_id, doc_id from docs where res), {_components_sql('eo')},
r13 as (select * from g13 where gram not in (select gram from t13)), h13 as (select r13.doc_id, unnest(range(r13.pos, r13.pos + 13)) place from r13 where gram in (select gram from g13a join docs using (doc_id) where not res)), c13 as (select doc_id, count(distinct place) covered from h13 group by 1),
x1 as (select x.doc_id node from docs x where x.res and x.body <> '' and x.body in (select body from docs where not res)), x2 as (select distinct a node from p where {_NEAR}),
x as (select node, 'normalized_reference_exact' reason from x1 union all select node, 'reference_near_duplicate' from x2 union all select doc_id, 'too_short_for_overlap_audit' from w where n < 10 and res
union all select doc_id, 'reference_local_coverage_ge_30pct' from c13 join w using (doc_id) where covered / n >= 0.3 and doc_id not in (select node from x1) and doc_id not in (select node from x2)
union all select doc_id, 'actual_array_exact' from documents where text is not null and {RES} and {Q.content_key('text')} in (select {Q.content_key('text')} from documents where text is not null and not {RES})),
i as (select component, list_sort(list(distinct reason)) rs, count(distinct node) n from m left join x using (node) group by 1)
select node, component, list_filter(list_concat(coalesce(list_filter(rs, lambda v: v is not null), []), [case when n > 100 then 'large_content_group_requires_review' end, case when node <> component then 'content_group_nonrepresentative' end]), lambda v: v is not null) reasons, len(reasons) = 0 eligible from m join i using (component)""")
def group_decision(spark, sf):
    """Which reserved documents may be taken: reasons of overlap with historical documents (an equal body,
    a near one, 30 % of the words in runs that one has and neither of the two, an equal text), or being too
    short, spread over content groups; one clean representative is eligible."""
    b = bodies(spark, sf)
    mine, theirs = b.where("reserved"), b.where("not reserved")
    one, other = materialize(representatives(mine), "contents"), materialize(representatives(theirs), "references")
    groups = connected_components(_edges(mine, FLOOR))
    members = mine.select(F.col("id").alias("node")).join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    exact = one.where("size(words) > 0").join(other.select("key"), "key", "left_semi").select("id")
    near = materialize(_near(one, other).select(F.col("a").alias("id")).distinct(), "near")
    covered = _masked(split_words(b).select("id", "source", "words")).where("try_divide(covered, words_n) >= 0.3").select("id").join(memberships(mine), "id").select(F.col("class_id").alias("id")).distinct()
    covered = covered.join(exact, "id", "left_anti").join(near, "id", "left_anti")
    k = _keyed(spark, sf)
    strict = k.where("reserved").join(k.where("not reserved").select("key").distinct(), "key", "left_semi").select(F.col("doc_id").alias("id"))
    said = [(exact, "normalized_reference_exact"), (near, "reference_near_duplicate"), (one.where("size(words) < 10").select("id"), "too_short_for_overlap_audit"), (covered, "reference_local_coverage_ge_30pct"), (strict, "actual_array_exact")]
    reasons = None
    for rows, reason in said:
        own = rows.select(F.col("id").alias("node"), F.lit(reason).alias("reason"))
        reasons = own if reasons is None else reasons.unionByName(own)
    return dedup.decisions(members, reasons)


@query(None)
def minhash_pairs(spark, sf):
    """Every pair that meets in a band bucket (14 bands of 8), verified: exact similarity 0.7 or more.
    Banding finds a pair at 0.7 with probability 56 %, at 0.8 92 %; internal_edges is exact at 0.8."""
    w = materialize(worded(spark, sf), "words")
    return similar_in_buckets(w, S.minhash_bands(w, "id", "words"), 0.7)


def similar_in_buckets(w: DataFrame, bands: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs of any bucket whose exact similarity is `least` or more."""
    pairs = materialize(S.bucket_pairs(bands, "id"), "pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(S.gram_sets(w.join(met, "id", "left_semi"), "id", "words", 5), "sets")
    p = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b").withColumn("shared", F.size(F.array_intersect("ga", "gb")))
    return p.select("a", "b", S.jaccard().alias("jaccard")).where(F.col("jaccard") >= least)


@query(None)
def minhash_clusters(spark, sf):
    """Clusters of all band links, unverified as in the reference, one representative each."""
    bands = materialize(S.minhash_bands(worded(spark, sf), "id", "words"), "bands")
    c = connected_components(S.band_links(bands, "id"))
    return c.groupBy("component").agg(F.count("*").alias("members")).withColumnRenamed("component", "representative")


@query("select subject, count(*) items, count(distinct text_sha) passages, min(item_id) first_item from eval_items where passage is not null group by 1")
def passage_sharing(spark, sf):
    return table(spark, sf, "eval_items").where("passage is not null").groupBy("subject").agg(F.count("*").alias("items"), F.countDistinct("text_sha").alias("passages"), F.min("item_id").alias("first_item"))


@query("""
with h as (select *, row_number() over (partition by subject order by item_id) rn from eval_items), s as (select subject, question, choices from h where rn <= 2)
select item_id, subject from h where rn > 2 and not exists (select 1 from s where s.subject is not distinct from h.subject and s.question is not distinct from h.question and s.choices is not distinct from h.choices)""")
def holdout(spark, sf):
    """Evaluation items without the shots (the first two of each subject) and whatever equals a shot."""
    w = Window.partitionBy("subject").orderBy("item_id")
    h = table(spark, sf, "eval_items").select("item_id", "subject", "question", "choices", F.row_number().over(w).alias("rn"))
    s = h.where("rn <= 2").select(F.col("subject").alias("a"), F.col("question").alias("b"), F.col("choices").alias("c"))
    same = F.col("subject").eqNullSafe(F.col("a")) & F.col("question").eqNullSafe(F.col("b")) & F.col("choices").eqNullSafe(F.col("c"))
    return h.where("rn > 2").join(s, same, "left_anti").select("item_id", "subject")


@query("""
with f as (select token_sha, arg_min(source_shard, record_id) first_shard, min(record_id) first_id from records where token_sha is not null group by 1)
select source_shard, count(*) matches, count_if(source_shard = first_shard)::bigint same_shard, count_if(source_shard <> first_shard)::bigint cross_shard from records join f using (token_sha) where record_id > first_id group by 1""")
def cross_shard(spark, sf):
    """Later copies by whether the first copy is of the same shard."""
    r = table(spark, sf, "records").where("token_sha is not null").select("token_sha", "record_id", "source_shard")
    first = r.groupBy("token_sha").agg(F.min_by("source_shard", "record_id").alias("first_shard"), F.min("record_id").alias("first_id"))
    m = r.join(first, "token_sha").where("record_id > first_id")
    same = F.col("source_shard") == F.col("first_shard")
    return m.groupBy("source_shard").agg(F.count("*").alias("matches"), F.count_if(same).alias("same_shard"), F.count_if(~same).alias("cross_shard"))
