"""Queries that read, normalize and assemble texts and token streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import streams as T
from corpusmill.operators.rouge import lcs_f1
from corpusmill.operators.splitting import split_sentences, split_words
from corpusmill.plans import sql as Q
from corpusmill.plans.registry import docs, query, table
from corpusmill.sources.files import decoded, publish, roundtrip, unpacked


def _texts(spark, sf):
    return docs(spark, sf).where("text is not null")


@query("select doc_id, source, source_row, length(text)::int chars, octet_length(encode(text))::int bytes from documents where text is not null")
def scan_rows(spark, sf):
    """Every row with its place and size."""
    return _texts(spark, sf).select("doc_id", "source", "source_row", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


@query("select doc_id, length(text)::int chars from documents where text like '%telescope%' and lang = 'en'")
def text_search(spark, sf):
    return docs(spark, sf).where("text like '%telescope%' and lang = 'en'").select("doc_id", F.length("text").alias("chars"))


@query(f"select doc_id, {Q.body('text')} body from documents where text is not null")
def normalize_body(spark, sf):
    """Matching text: lower-cased words and marks joined by one space."""
    return _texts(spark, sf).select("doc_id", X.body(F.col("text")).alias("body"))


@query(None)
def normalize_exact(spark, sf):
    """The exact profile: NFKC, brackets, case folding."""
    t = F.regexp_extract_all(X.folded(F.col("text")), F.lit(X.TOKEN), F.lit(0))
    return _texts(spark, sf).select("doc_id", F.array_join(t, " ").alias("body"))


@query(f"select doc_id, {Q.content_key('text')} text_key, lower(text_sha) is not distinct from {Q.content_key('text')} fresh from documents where text is not null")
def text_key(spark, sf):
    """Content key of each text, and whether the stored one is still right."""
    return _texts(spark, sf).select("doc_id", X.content_key(F.col("text")).alias("text_key"), F.lower("text_sha").alias("s")).select("doc_id", "text_key", F.col("s").eqNullSafe(F.col("text_key")).alias("fresh"))


@query("select doc_id, sha256(text) sha, octet_length(encode(text))::int bytes from documents where text is not null")
def doc_sha(spark, sf):
    return _texts(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("bytes"))


@query(f"select doc_id, {Q.replaced('text')} text from documents where contains(text, 'B-')")
def brackets_native(spark, sf):
    """Texts with bracket escapes, read."""
    return docs(spark, sf).where(F.contains("text", F.lit("B-"))).select("doc_id", X.brackets(F.col("text")).alias("text"))


@query("select escape, sum(len(regexp_extract_all(text, escape)))::bigint n, count_if(contains(text, escape))::bigint documents from documents, (values ('-LRB-'), ('-RRB-'), ('-LCB-'), ('-RCB-'), ('-LSB-'), ('-RSB-')) v(escape) where text is not null group by 1")
def bracket_counts(spark, sf):
    counts = F.explode(F.array(*(F.struct(F.lit(e).alias("escape"), F.regexp_count("text", F.lit(e)).alias("n")) for e in X.BRACKETS))).alias("x")
    return _texts(spark, sf).select(counts).select("x.*").groupBy("escape").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("documents"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x{FFFD}\x{FEFF}]', '', 'g'), '[ \t\x0b\f\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')) text from documents where text is not null")
def preclean(spark, sf):
    """Without replacement characters and marks of byte order, blanks as one, none around line ends."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[\x{FFFD}\x{FEFF}]", ""), r"[ \t\x0b\f\r]+", " "), r" ?\n ?", "\n")
    return _texts(spark, sf).select("doc_id", F.trim(t).alias("text"))


@query(f"select item_id, sha256(lower({Q.squeezed(chr(39) + chr(39) + ' || ' + 'list_aggregate(list_sort(choices), ' + chr(39) + 'string_agg' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ') || ' + chr(39) + ' ' + chr(39) + ' || passage || ' + chr(39) + ' ' + chr(39) + ' || question')})) digest from eval_items where passage is not null and question is not null and choices is not null")
def record_digest(spark, sf):
    """Digest of an item's texts, whatever the order of its choices; keys and answer don't count."""
    i = table(spark, sf, "eval_items").where("passage is not null and question is not null and choices is not null")
    return i.select("item_id", F.sha2(F.lower(X.squeezed(F.concat_ws(" ", F.array_join(F.array_sort("choices"), " "), "passage", "question"))), 256).alias("digest"))


@query("select item_id, subject, unnest(choices) choice, unnest(range(len(choices))) cont_id, answer from eval_items where choices is not null")
def extract_choices(spark, sf):
    """One row a choice."""
    return table(spark, sf, "eval_items").where("choices is not null").select("item_id", "subject", F.posexplode("choices").alias("cont_id", "choice"), "answer").withColumn("cont_id", F.col("cont_id").cast("bigint"))


@query("select record_id, json_extract_string(meta, '$.title') title, json_extract_string(meta, '$.lang') lang, json_extract_string(meta, '$.tokens') tokens from records where meta is not null")
def extract_fields(spark, sf):
    """Fields of the metadata objects."""
    g = lambda f: F.get_json_object("meta", f"$.{f}").alias(f)
    return table(spark, sf, "records").where("meta is not null").select("record_id", g("title"), g("lang"), g("tokens"))


@query("select item_id, replace(question, '?', ' ' || choices[answer + 1] || '.') filled, answer + 1 answer_key from eval_items where answer between 0 and len(choices) - 1")
def template_fill(spark, sf):
    """The question with the right choice in the place of its mark."""
    i = table(spark, sf, "eval_items").where("answer between 0 and size(choices) - 1")
    return i.select("item_id", F.replace("question", F.lit("?"), F.concat(F.lit(" "), F.get("choices", F.col("answer")), F.lit("."))).alias("filled"), (F.col("answer") + 1).alias("answer_key"))


@query("select item_id, case when answer is null then 'missing' when answer < 0 or answer >= len(choices) then 'out_of_range' when len(list_distinct(choices)) < len(choices) then 'repeated_choice' else 'ok' end status, case when answer between 0 and len(choices) - 1 then list_position(choices, choices[answer + 1]) - 1 end answer from eval_items")
def answer_fix(spark, sf):
    """Answer keys by kind of error; with repeated choices, the first equal one is the answer."""
    n = F.size("choices")
    status = F.when(F.col("answer").isNull(), "missing").when((F.col("answer") < 0) | (F.col("answer") >= n), "out_of_range").when(F.size(F.array_distinct("choices")) < n, "repeated_choice").otherwise("ok")
    key = F.when(F.col("answer").between(0, n - 1), F.array_position("choices", F.get("choices", F.col("answer"))) - 1)
    return table(spark, sf, "eval_items").select("item_id", status.alias("status"), key.alias("answer"))


@query(None)
def split_long(spark, sf):
    """Sentences of at most 40 words, cut at the last mark that fits, else hard."""
    return split_sentences(docs(spark, sf), "doc_id", "text", 40)


@query(None)
def split_budget(spark, sf):
    """Greedy pieces of at most 128 words that end at a sentence where they can."""
    return split_words(docs(spark, sf), "doc_id", "text", 128)


_TOK = f"tk as (select doc_id, source, source_row, list_concat([50257], list_transform({Q.tokens('text')}, lambda w: ('0x' || sha256(w)[1:4])::int % 50000), [50256]) ids from documents where text is not null)"


def _ids(spark, sf):
    """Documents with word hashes as token ids."""
    ids = F.transform(X.tokens(F.col("text")), lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 4), 16, 10).cast("int") % 50000)
    return _texts(spark, sf).select("doc_id", "source", "source_row", ids.alias("ids"))


@query(f"with {_TOK} select source, count(*) documents, sum(len(ids))::bigint tokens from tk group by 1")
def count_tokens(spark, sf):
    """Documents and tokens, with markers, of each shard."""
    return _ids(spark, sf).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("ids") + 2).alias("tokens"))


_OFF = f"{_TOK}, o as (select *, sum(len(ids)) over (partition by source order by source_row, doc_id)::bigint stop from tk)"


@query(f"with {_OFF} select doc_id, source, stop - len(ids) as start, stop from o")
def doc_bounds(spark, sf):
    """Half-open places of each document in its shard's stream."""
    return T.offsets(_ids(spark, sf), "source", ["source_row", "doc_id"], F.size("ids") + 2).select("doc_id", "source", "start", "stop")


def _stream(spark, sf):
    o = T.offsets(_ids(spark, sf), "source", ["source_row", "doc_id"], F.size("ids") + 2)
    return T.stream(o, "source", "start", "ids").select("source", (F.col("start") + F.col("i")).alias("pos"), "tok")


@query(f"with {_OFF} select source, stop - len(ids) as start, stop, true valid from o")
def segment_bos(spark, sf):
    """Documents found again in the flat stream by their markers."""
    return T.segments(_stream(spark, sf), "source", "pos", "tok")


@query(f"with {_OFF} select source, stop - len(ids) as start, stop, true valid from o")
def segment_eos(spark, sf):
    """Documents found by their end marks."""
    return T.ends(_stream(spark, sf), "source", "pos", "tok")


@query(f"with {_OFF}, m as (select source, max(stop) top from o group by 1) select source, stop - len(ids) as start, stop - (stop = top)::int stop, stop < top valid from o join m using (source)")
def segment_eos_open(spark, sf):
    """segment_eos of streams whose last token is lost: the unfinished document isn't valid."""
    x = _stream(spark, sf)
    top = x.groupBy("source").agg(F.max("pos").alias("top"))
    return T.ends(x.join(top, "source").where("pos < top").drop("top"), "source", "pos", "tok")


@query(f"with {_OFF} select source, stop - len(ids) as start, stop, doc_id % 3 <> 0 valid from o")
def segment_bos_damaged(spark, sf):
    """segment_bos of streams in which every third document has an end mark for its second token, or in place of its
    only one."""
    o = T.offsets(_ids(spark, sf), "source", ["source_row", "doc_id"], F.size("ids") + 2)
    x = T.stream(o, "source", "start", "ids").join(o.select("source", "start", "doc_id"), ["source", "start"])
    hurt = (F.col("doc_id") % 3 == 0) & (F.col("i") == 1)
    x = x.select("source", (F.col("start") + F.col("i")).alias("pos"), F.when(hurt, F.when(F.col("tok") == T.EOS, 7).otherwise(T.EOS)).otherwise(F.col("tok")).alias("tok"))
    return T.segments(x, "source", "pos", "tok")


@query(f"with {_OFF} select source, count(*) documents, min(stop - len(ids)) = 0 begins_at_0, max(stop)::bigint tokens, true whole from o group by 1")
def stream_checks(spark, sf):
    """From the markers alone: whether each stream begins with a document and its documents follow each other to its end."""
    x = _stream(spark, sf)
    top = x.groupBy("source").agg((F.max("pos") + 1).alias("top"))
    s = T.segments(x, "source", "pos", "tok").where("valid").groupBy("source").agg(F.count("*").alias("documents"), F.min("start").alias("low"), F.max("stop").alias("tokens"), F.sum(F.col("stop") - F.col("start")).alias("held"))
    return s.join(top, "source").select("source", "documents", (F.col("low") == 0).alias("begins_at_0"), "tokens", ((F.col("held") == F.col("top")) & (F.col("tokens") == F.col("top"))).alias("whole"))


@query(f"with {_TOK}, c as (select doc_id, ids, len(ids) // 64 n from tk) select doc_id, list_transform(range(n), lambda k: ids[k * 64 + 1:k * 64 + 64]) chunks, len(ids) - n * 64 dropped from c")
def fixed_chunks(spark, sf):
    """Chunks of 64 ids of each document with its markers; the rest is dropped."""
    d = _ids(spark, sf).select("doc_id", F.concat(F.array(F.lit(T.BOS)), "ids", F.array(F.lit(T.EOS))).alias("ids"))
    return d.select("doc_id", T.chunks(F.col("ids"), 64).alias("chunks"), (F.size("ids") % 64).cast("bigint").alias("dropped"))


@query(f"with {_OFF}, b as (select source, stop - len(ids) as start, stop from o), c as (select source, start, stop, unnest(range(start // 1024, (stop - 1) // 1024 + 1)) chunk from b) select source, chunk, list(least(stop, (chunk + 1) * 1024) - greatest(start, chunk * 1024) order by start) lengths from c group by 1, 2")
def doc_lens(spark, sf):
    """Lengths of the documents, or parts of them, in each chunk of 1,024 tokens of a shard's stream."""
    o = T.offsets(_ids(spark, sf), "source", ["source_row", "doc_id"], F.size("ids") + 2)
    return T.chunk_lengths(o, "source", "start", "stop", 1024)


@query(f"with {_TOK}, w as (select doc_id, ids, max(len(ids)) over (partition by source, source_row // 8) width from tk) select doc_id, list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0)) padded, list_concat(list_transform(range(len(ids)), lambda i: 1), list_transform(range(width - len(ids)), lambda i: 0)) mask from w")
def pad_batch(spark, sf):
    """Documents padded to the width of their batch (eight rows of a shard), with the mask."""
    d = _ids(spark, sf).select("doc_id", "source", F.floor(F.col("source_row") / 8).alias("batch"), F.concat(F.array(F.lit(T.BOS)), "ids", F.array(F.lit(T.EOS))).alias("ids"))
    width = d.groupBy("source", "batch").agg(F.max(F.size("ids")).alias("width"))
    d = d.join(width, ["source", "batch"])
    return d.select("doc_id", T.padded(F.col("ids"), F.col("width"), 0).alias("padded"), T.padded(F.transform("ids", lambda t: F.lit(1)), F.col("width"), 0).alias("mask"))


@query("with m as (select doc_id, unnest(regexp_extract_all(text, '-[LR][RCS]B-')) old, unnest(range(1, len(regexp_extract_all(text, '-[LR][RCS]B-')) + 1)) k, regexp_split_to_array(text, '-[LR][RCS]B-') parts from documents where text is not null) select doc_id, (list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * 5)::int as \"at\", old, case old when '-LRB-' then '(' when '-RRB-' then ')' when '-LCB-' then '{' when '-RCB-' then '}' when '-LSB-' then '[' else ']' end as new, (k * -4)::int shift from m")
def patch_translate(spark, sf):
    """Replacements of bracket escapes as ordered patches, with the shift of later places."""
    return T.patches(docs(spark, sf), "doc_id", "text", X.BRACKETS)


@query("with s as (select distinct source_shard, source_row from split_items) select d.source, count(*) documents, sum(length(text))::bigint chars, min(d.source_row) first_row, max(d.source_row) last_row from documents d join s on s.source_shard = d.source and s.source_row = d.source_row group by 1")
def assemble_split(spark, sf):
    """The documents of the split index, by shard."""
    s = table(spark, sf, "split_items").select(F.col("source_shard").alias("source"), "source_row").distinct()
    d = docs(spark, sf).join(s, ["source", "source_row"], "left_semi")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"))


@query("select split::int split, count(*) written, 0::bigint lost, 0::bigint added from records group by 1")
def export_roundtrip(spark, sf):
    """Records written by split, read back and compared both ways."""
    return roundtrip(table(spark, sf, "records").select("record_id", "split", "token_sha", "text"), "split")


@query("select p.source_shard, p.source_row, parse_id, d.doc_id, d.doc_id is not null paired from (select source_shard, source_row, min(parse_id) parse_id from parses group by 1, 2) p left join documents d on d.source = p.source_shard and d.source_row = p.source_row")
def pair_check(spark, sf):
    """Parses and documents paired by place."""
    p = table(spark, sf, "parses").groupBy("source_shard", "source_row").agg(F.min("parse_id").alias("parse_id"))
    d = docs(spark, sf).select(F.col("source").alias("source_shard"), "source_row", "doc_id")
    return p.join(d, ["source_shard", "source_row"], "left").withColumn("paired", F.col("doc_id").isNotNull())


@query(f"with l as (select token_sha, min(record_id) a from records where token_sha is not null and text is not null group by 1 having count(*) > 1), s as (select record_id, token_sha, list_distinct({Q.tokens('text')}) ws from records where text is not null) select l.a, y.record_id b, round(len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))), 9) jaccard from l join s x on x.record_id = l.a join s y on y.token_sha = l.token_sha and y.record_id > l.a where len(list_concat(x.ws, y.ws)) > 0")
def pair_verify(spark, sf):
    """Every member of a token hash's group against the group's first, one row a member."""
    r = table(spark, sf, "records").where("text is not null and token_sha is not null")
    low = r.groupBy("token_sha").agg(F.min("record_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("token_sha", "a")
    s = r.select("record_id", "token_sha", F.array_distinct(X.tokens(F.col("text"))).alias("ws"))
    first = low.join(s.select(F.col("record_id").alias("a"), F.col("ws").alias("x")), "a").select("token_sha", "a", "x")
    j = first.join(s.select("token_sha", F.col("record_id").alias("b"), F.col("ws").alias("y")), "token_sha").where("b > a and size(x) + size(y) > 0")
    return j.select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 9).alias("jaccard"))


@query("with recursive c as (select 1 n, 1::hugeint catalan union all select n + 1, catalan * 2 * (2 * n - 1) // (n + 1) from c where n < 30) select n::int n, least(catalan, 300)::int capped from c")
def capped_counts(spark, sf):
    """Numbers of binary trees over n leaves, 300 at most (a table of 30 rows)."""
    rows, catalan = [], 1
    for n in range(1, 31):
        rows.append((n, min(catalan, 300)))
        catalan = catalan * 2 * (2 * n - 1) // (n + 1)
    return spark.createDataFrame(rows, "n int, capped int")


@query("select item_id, count(*) words, count(distinct w) distinct_words from (select item_id, unnest(regexp_extract_all(lower(passage), '[a-z]+')) w from eval_items where passage is not null) group by 1")
def passage_words(spark, sf):
    w = F.explode(F.regexp_extract_all(F.lower("passage"), F.lit("[a-z]+"), F.lit(0))).alias("w")
    return table(spark, sf, "eval_items").where("passage is not null").select("item_id", w).groupBy("item_id").agg(F.count("*").alias("words"), F.countDistinct("w").alias("distinct_words"))


@query(f"with t as (select doc_id, {Q.tokens('text')} ws from documents where text is not null) select doc_id, len(ws) - 4 as runs, sha256(array_to_string(ws[1:5], ' ')) first_run from t where len(ws) >= 5")
def ngrams(spark, sf):
    """How many runs of five words a document has, and its first."""
    g = _texts(spark, sf).select("doc_id", X.grams(X.tokens(F.col("text")), 5).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("runs"), F.sha2(F.get("g", F.lit(0)), 256).alias("first_run")).where("runs > 0")


@query("select event_type, date_trunc('hour', ts) as hour, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def event_hours(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {_TOK}, b as (select doc_id, list_concat([ids[1], 50256], ids[2:]) ids from tk) select doc_id, list_concat(list_filter(ids[1:len(ids) - 1], lambda t: t <> 50256), [50256]) cleaned, len(list_filter(ids, lambda t: t = 50256)) - 1 removed from b")
def inner_eos(spark, sf):
    """End marks inside a document (one is put in here) taken out; the last stays."""
    bad = _ids(spark, sf).select("doc_id", F.concat(F.array(F.lit(T.BOS), F.lit(T.EOS)), "ids", F.array(F.lit(T.EOS))).alias("ids"))
    inner = F.filter("ids", lambda t, i: (t != T.EOS) | (i == F.size("ids") - 1))
    return bad.select("doc_id", inner.alias("cleaned"), (F.size("ids") - F.size(inner)).cast("bigint").alias("removed"))


@query(None)
def rouge_l(spark, sf):
    """Longest common subsequence of question and passage, as F1."""
    return lcs_f1(table(spark, sf, "eval_items"), "item_id", "question", "passage")


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) line_no from documents where text is not null), o as (select *, octet_length(encode(line)) bytes from l) select doc_id, line_no::int line_no, (sum(bytes + 1) over (partition by doc_id order by line_no) - bytes - 1)::bigint as \"offset\", bytes::int bytes, sha256(line) line_sha from o")
def line_scan(spark, sf):
    """Every line with its number, the byte it begins at, its size and its digest."""
    rows = _texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).withColumn("bytes", F.octet_length("line"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one document
    return rows.select("doc_id", (F.col("k") + 1).alias("line_no"), F.coalesce(F.sum(F.col("bytes") + 1).over(before), F.lit(0)).alias("offset"), "bytes", F.sha2("line", 256).alias("line_sha"))


@query("select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{e}'))::int {e[1:4].lower()}" for e in X.BRACKETS) + " from documents where regexp_matches(text, '-[LR][RCS]B-')")
def bracket_counts_doc(spark, sf):
    """Escapes of each kind in every document that has one."""
    return _texts(spark, sf).where(F.col("text").rlike("-[LR][RCS]B-")).select("doc_id", *(F.regexp_count("text", F.lit(e)).alias(e[1:4].lower()) for e in X.BRACKETS))


@query(f"select doc_id, len(regexp_extract_all(text, '-[LR][RCS]B-'))::int patches, sha256({Q.replaced('text')}) forward, sha256(text) back from documents where text is not null")
def patch_replay(spark, sf):
    """Patches applied to the old text, and taken back from the new one: digests of what comes out."""
    p = T.patches(docs(spark, sf), "doc_id", "text", X.BRACKETS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "old", "new"))).alias("p"))
    d = _texts(spark, sf).join(p, "doc_id", "left").select("doc_id", "text", F.coalesce("p", F.array().cast("array<struct<at:int,old:string,new:string>>")).alias("p"))
    d = d.select("doc_id", "p", T.replayed(F.col("text"), F.col("p")).alias("new"))
    return d.select("doc_id", F.size("p").alias("patches"), F.sha2("new", 256).alias("forward"), F.sha2(T.replayed(F.col("new"), F.col("p"), False), 256).alias("back"))


@query(f"with l as (select doc_id, text, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) k, len(string_split(text, chr(10))) n from documents where text is not null), o as (select doc_id, text, k, n, sum(length(line) + 1) over (partition by doc_id order by k)::bigint old_at from l) select doc_id, old_at, length({Q.replaced('substr(text, 1, old_at)')})::bigint new_at from o where k < n")
def boundary_translation(spark, sf):
    """Where each line begins before and after bracket escapes are replaced."""
    return T.translated(docs(spark, sf), "doc_id", "text", X.BRACKETS)


@query(f"with {_TOK}, w as (select doc_id, ids, max(len(ids)) over (partition by source, source_row // 8) width from tk) select doc_id, list_concat(list_transform(range(width - len(ids)), lambda i: 0), ids) padded, list_concat(list_transform(range(width - len(ids)), lambda i: 0), list_transform(range(len(ids)), lambda i: 1)) mask, (width - len(ids))::int span_offset from w")
def pad_batch_left(spark, sf):
    """As pad_batch, on the left side, with how far places in a document move."""
    d = _ids(spark, sf).select("doc_id", "source", F.floor(F.col("source_row") / 8).alias("batch"), F.concat(F.array(F.lit(T.BOS)), "ids", F.array(F.lit(T.EOS))).alias("ids"))
    d = d.join(d.groupBy("source", "batch").agg(F.max(F.size("ids")).alias("width")), ["source", "batch"])
    return d.select("doc_id", T.padded(F.col("ids"), F.col("width"), 0, True).alias("padded"), T.padded(F.transform("ids", lambda t: F.lit(1)), F.col("width"), 0, True).alias("mask"), (F.col("width") - F.size("ids")).alias("span_offset"))


@query("with recursive c as (select 1 n, 1::hugeint a, 1::hugeint b union all select n + 1, b, case when n = 1 then 3 else ((6 * (n + 2) - 9) * b - (n - 1) * a) // (n + 2) end from c where n < 30) select n::int n, least(a, 300)::int capped from c")
def capped_trees(spark, sf):
    """Numbers of trees over n leaves whose nodes have two parts or more (little Schroeder numbers), 300 at most."""
    s = [0, 1, 1]
    for n in range(3, 31):
        s.append(((6 * n - 9) * s[n - 1] - (n - 3) * s[n - 2]) // n)
    return spark.createDataFrame([(n, min(s[n], 300)) for n in range(1, 31)], "n int, capped int")


@query(r"select doc_id, trim(regexp_replace(regexp_replace(text, '\[[a-z_ ]{1,20}\]|<[^<>\n]{1,100}>', ' ', 'g'), '[ \t]+', ' ', 'g')) cleaned from documents where text is not null")
def tag_clean(spark, sf):
    """Bracketed and angled tags taken out of texts."""
    t = F.regexp_replace(F.regexp_replace("text", r"\[[a-z_ ]{1,20}\]|<[^<>\n]{1,100}>", " "), r"[ \t]+", " ")
    return _texts(spark, sf).select("doc_id", F.trim(t).alias("cleaned"))


@query(r"select doc_id, sha256(case when doc_id % 3 = 0 then text else regexp_replace(text, '^\x{FEFF}', '') end) sha from documents where text is not null")
def decode_mixed(spark, sf):
    """Texts that come as bytes of several encodings, read by their marks or by what they are valid as."""
    latin = F.col("text").rlike(r"^[\x09\x0a\x0d\x20-\x7e\xa0-\xff]*$") & F.col("text").rlike(r"[\xc0-\xff](?:[\x00-\x7f]|$)")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).when((F.col("doc_id") % 3 == 1) & latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return _texts(spark, sf).select("doc_id", F.sha2(decoded(raw), 256).alias("sha"))


@query(f"select i.item_id, c.k::int cont_id, case when length(c.b) > 0 and instr(' ' || i.p || ' ', ' ' || c.b || ' ') > 0 then (length(left(' ' || i.p || ' ', instr(' ' || i.p || ' ', ' ' || c.b || ' '))) - length(replace(left(' ' || i.p || ' ', instr(' ' || i.p || ' ', ' ' || c.b || ' ')), ' ', '')) - 1)::int else -1 end first_word from (select item_id, {Q.body('passage')} p from eval_items where passage is not null) i join (select item_id, k, {Q.body('c')} b from (select item_id, unnest(choices) c, unnest(range(len(choices))) k from eval_items where choices is not null)) c using (item_id)")
def subsequence_index(spark, sf):
    """Where a choice's words stand next to each other in the passage: the place of the first, -1 if nowhere."""
    i = table(spark, sf, "eval_items").where("passage is not null and choices is not null").select("item_id", F.concat(F.lit(" "), X.body(F.col("passage")), F.lit(" ")).alias("p"), F.posexplode("choices").alias("cont_id", "c"))
    i = i.withColumn("b", X.body(F.col("c"))).withColumn("at", F.expr("instr(p, concat(' ', b, ' '))"))
    before = F.expr("left(p, at)")
    place = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1
    return i.select("item_id", "cont_id", F.when((F.length("b") > 0) & (F.col("at") > 0), place).otherwise(-1).alias("first_word"))


@query("select split::int split, count(*) n, count(*) back, 0::bigint lost, 0::bigint added from records group by 1")
def unpack_verify(spark, sf):
    """Records exported as compressed JSON lines, unpacked and compared both ways."""
    return unpacked(table(spark, sf, "records").select("record_id", "split", "token_sha", "text"), "split")


@query("select split::int split, count(*) row_count, coalesce(sum(length(text)), 0)::bigint chars, true committed from records group by 1")
def publish_manifest(spark, sf):
    """Records written aside, checked, and published with a manifest row for each split."""
    return publish(table(spark, sf, "records").select("record_id", "split", "text"), "split", "text")


@query("select count(*) found from (select 1 from documents where contains(text, 'telescope') limit 1)")
def exists_match(spark, sf):
    """Whether any document has a phrase: stops at the first one."""
    return docs(spark, sf).where(F.contains("text", F.lit("telescope"))).limit(1).agg(F.count("*").alias("found"))


@query("with u as (select text, count(*) n, min(record_id) first_id from records where text is not null group by 1), d as (select text, " + Q.tokens("text") + " ws from u) select r.record_id, len(d.ws)::int words, sha256(array_to_string(d.ws, ' ')) body_sha from records r join d using (text)")
def decode_once(spark, sf):
    """Words of every record, counted once for each different text and joined back."""
    r = table(spark, sf, "records").where("text is not null").select("record_id", "text", F.sha2("text", 256).alias("k"))
    once = r.groupBy("k").agg(F.min("text").alias("t")).select("k", X.tokens(F.col("t")).alias("ws"))
    return r.select("record_id", "k").join(once.select("k", F.size("ws").alias("words"), F.sha2(F.array_join("ws", " "), 256).alias("body_sha")), "k").select("record_id", "words", "body_sha")


@query(None)
def rouge_mean(spark, sf):
    """F1 of words, of word pairs and of the longest common subsequence of question and passage, and their mean."""
    from corpusmill.plans.metrics import rouge12

    both = rouge12(spark, sf).groupBy("item_id").pivot("n", [1, 2]).agg(F.first("f1")).toDF("item_id", "f1", "f2")
    l = rouge_l(spark, sf).select("item_id", F.col("f1").alias("fl"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.join(l, "item_id").select("item_id", "f1", "f2", "fl", ((zero("f1") + zero("f2") + zero("fl")) / 3).alias("mean"))
