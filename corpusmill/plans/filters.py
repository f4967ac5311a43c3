"""Queries that filter, classify and count documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import signals as S
from corpusmill.functions import text as X
from corpusmill.operators import filters as L
from corpusmill.operators import ordered
from corpusmill.plans import SQL as QUERIES_SQL
from corpusmill.plans import sql as Q
from corpusmill.plans.registry import docs, query, table
from corpusmill.session import spread


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _reasons(text: str, rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({text}, {_lit(p)}) then '{n}' end" for n, p in rules.items()) + "], lambda v: v is not null)"


def _lines(of: str) -> str:
    return f"ln as (select doc_id, length(text) chars, unnest(string_split(text, chr(10))) line from {of} where text is not null), sq as (select doc_id, chars, {Q.squeezed('line')} line from ln), dom as (select doc_id, chars, line, count(*) n from sq where length(line) >= 80 group by 1, 2, 3)"


def _repeats(of: str) -> str:
    strip = f"regexp_replace(unnest(string_split(text, chr(10))), '^[{Q.SPACE}]+|[{Q.SPACE}]+$', '', 'g')"
    return f"rl as (select doc_id, length(text) chars, {strip} line from {of} where text is not null), rc as (select doc_id, chars, line, count(*) n from rl where length(line) >= 80 group by 1, 2, 3 having count(*) >= 3 and length({Q.squeezed('line')}) - length(replace({Q.squeezed('line')}, ' ', '')) >= 7)"


_DOMINANT = "select doc_id, max(n) copies from dom where n >= 4 and n * length(line) >= 0.3 * chars group by 1"
_REPEATED = "select doc_id, sum((n - 1) * length(line))::bigint repeated_chars, round(sum((n - 1) * length(line)) / chars, 9) fraction, max(n) most_copies from rc group by doc_id, chars"
#: Every document with its beginning again as lines of their own: four times where the id is odd, else three times.
_PLANTED = f"pl as (select doc_id, text || repeat(chr(10) || left({Q.squeezed('text')}, 120), case when doc_id % 2 = 1 then 4 else 3 end) as text from documents where text is not null)"


def _planted(spark, sf):
    line = F.concat(F.lit("\n"), F.substring(X.squeezed(F.col("text")), 1, 120))
    return docs(spark, sf).where("text is not null").select("doc_id", F.concat("text", F.repeat(line, F.when(F.col("doc_id") % 2 == 1, 4).otherwise(3))).alias("text"))


def _dominant(d):
    return L.line_counts(d, "doc_id", "text", True).where("n >= 4 and n * length(line) >= 0.3 * chars").groupBy("doc_id").agg(F.max("n").alias("copies"))


def _repeated(d):
    again = F.sum((F.col("n") - 1) * F.length("line"))
    return L.repeated_lines(d, "doc_id", "text").groupBy("doc_id", "chars").agg(again.alias("repeated_chars"), F.round(again / F.col("chars"), 9).alias("fraction"), F.max("n").alias("most_copies")).drop("chars")


@query(f"with {_lines('documents')} {_DOMINANT}")
def dominant_line(spark, sf):
    """Documents in which one long line is repeated and makes up a third."""
    return _dominant(docs(spark, sf))


@query(f"with {_PLANTED}, {_lines('pl')} {_DOMINANT}")
def dominant_line_planted(spark, sf):
    """dominant_line of documents that have their beginning several times more."""
    return _dominant(_planted(spark, sf))


@query(f"with {_repeats('documents')} {_REPEATED}")
def repeated_lines(spark, sf):
    """Lines of 80 characters and 8 words or more that stand three times or more in their document."""
    return _repeated(docs(spark, sf))


@query(f"with {_PLANTED}, {_repeats('pl')} {_REPEATED}")
def repeated_lines_planted(spark, sf):
    """repeated_lines of documents that have their beginning several times more."""
    return _repeated(_planted(spark, sf))


_PAGE = f"{_lines('documents')}, dm as (select distinct doc_id from dom where n >= 4 and n * length(line) >= 0.3 * chars), r as (select doc_id, {_reasons('text', S.REASONS)} rs from documents where text is not null), pr as (select doc_id, case when dm.doc_id is not null then list_append(rs, 'dominant_repeated_line') else rs end reasons from r left join dm using (doc_id))"


@query(f"with {_PAGE} select * from pr")
def page_reasons(spark, sf):
    """Reasons of the page to leave a document out: all but formulas."""
    d = spread(docs(spark, sf)).where("text is not null").select("doc_id", L.reasons(F.col("text")).alias("rs"))
    dm = dominant_line(spark, sf).select("doc_id", F.lit("dominant_repeated_line").alias("extra"))
    return d.join(dm, "doc_id", "left").select("doc_id", F.array_compact(F.array_append("rs", F.col("extra"))).alias("reasons"))


@query(f"with {_PAGE}, e as (select unnest(reasons) reason from pr) select reason, count(*) documents from e group by 1")
def page_reason_counts(spark, sf):
    """Documents by reason of the page; a document may have several."""
    return page_reasons(spark, sf).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("documents"))


@query(None)
def quality_reasons(spark, sf):
    """Reasons to leave a document out of the collection, formulas first; none keeps it. No SQL: the
    formula rules read around each match."""
    f = formula_class(spark, sf).select("doc_id", F.when(F.col("decision") != "keep", F.concat(F.lit("formula_"), "decision")).alias("f"))
    return page_reasons(spark, sf).join(f, "doc_id").select("doc_id", F.array_compact(F.concat(F.array("f"), "reasons")).alias("reasons")).withColumn("keep", F.size("reasons") == 0)


@query(None)
def reason_counts(spark, sf):
    """Documents by reason; a document may have several."""
    return quality_reasons(spark, sf).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("documents"))


_QUOTED = r"len(list_filter(regexp_extract_all(regexp_replace(text, '([\p{L}\p{N}_])', '\1\1', 'g'), '[\p{L}\p{N}_]?(?:``|'''')[\p{L}\p{N}_]?'), lambda m: length(m) = 2))"
_FOUND = (
    " union all ".join(f"select doc_id, '{n}' signal, len(regexp_extract_all(text, {_lit(p)}))::int occurrences from documents where text is not null" for n, p in S.SIGNALS.items())
    + f" union all select doc_id, 'ptb_quote', {_QUOTED}::int from documents where text is not null"
    + r" union all select doc_id, 'pipe_table_candidate', case when length(text) - length(replace(text, '|', '')) >= 10 then length(text) - length(replace(text, '|', '')) else 0 end::int from documents where text is not null"
    + f" union all select doc_id, 'repeated_long_line_candidate', sum(n - 1)::int from (with {_repeats('documents')} select * from rc) group by 1"
)


@query(f"select * from ({_FOUND}) where occurrences > 0")
def signals(spark, sf):
    """Occurrences of each visible signal in each document."""
    return L.signal_rows(spread(docs(spark, sf)), "doc_id", "text")


@query(None)
def signal_examples(spark, sf):
    """The first two matches of each signal in each document."""
    return L.signal_examples(spread(docs(spark, sf)), "doc_id", "text")


@query(f"select signal, doc_id, occurrences, rn from (select *, row_number() over (partition by signal order by occurrences desc, doc_id) rn from ({_FOUND}) where occurrences > 0) where rn <= 15")
def topk_signal(spark, sf):
    """The 15 documents that show each signal most."""
    return ordered.top(signals(spark, sf), 15, ["signal"], F.desc("occurrences"), F.asc("doc_id")).select("signal", "doc_id", "occurrences", "rn")


@query(f"select signal, count(*) documents, sum(occurrences)::bigint occurrences, max(occurrences) most from ({_FOUND}) where occurrences > 0 group by 1")
def signal_stats(spark, sf):
    return signals(spark, sf).groupBy("signal").agg(F.count("*").alias("documents"), F.sum("occurrences").alias("occurrences"), F.max("occurrences").alias("most"))


@query(f"select doc_id, {_reasons('text', S.FORMULAS)} kinds from documents where text is not null and len({_reasons('text', S.FORMULAS)}) > 0")
def formula_latex(spark, sf):
    """Documents with formulas that marks alone show: LaTeX, MathML, dollars or calculus signs."""
    return spread(docs(spark, sf)).select("doc_id", L.reasons(F.col("text"), S.FORMULAS).alias("kinds")).where(F.size("kinds") > 0)


@query(None)
def formula_class(spark, sf):
    """Decision on formulas: certain ones drop a document, likely ones have it reviewed."""
    return L.formula_rows(spread(docs(spark, sf)).where("text is not null"), "doc_id", "text").select("doc_id", "decision", "confirmed", "uncertain")


@query(None)
def formula_signals(spark, sf):
    """Each signal of a formula with its place, at most 20 a document."""
    return L.formula_rows(spread(docs(spark, sf)).where("text is not null"), "doc_id", "text").select("doc_id", F.explode("signals").alias("s")).select("doc_id", "s.*")


def _decided(spark, sf):
    return L.formula_rows(spread(docs(spark, sf)).where("text is not null"), "doc_id", "text")


@query(None)
def decision_stats(spark, sf):
    """Documents and tokens by formula decision and language."""
    d = docs(spark, sf).where("text is not null").select("doc_id", "lang", F.size(X.tokens(F.col("text"))).alias("n"))
    return d.join(_decided(spark, sf).select("doc_id", "decision"), "doc_id").groupBy("decision", "lang").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


@query(None)
def signal_decisions(spark, sf):
    """Visible signals by formula decision: documents and occurrences."""
    s = signals(spark, sf).join(_decided(spark, sf).select("doc_id", "decision"), "doc_id")
    return s.groupBy("signal", "decision").agg(F.count("*").alias("documents"), F.sum("occurrences").alias("occurrences"))


@query(None)
def smallest_by_decision(spark, sf):
    """The 20 shortest documents of each formula decision."""
    d = docs(spark, sf).where("text is not null").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")).join(_decided(spark, sf).select("doc_id", "decision"), "doc_id")
    return ordered.top(d, 20, ["decision"], F.asc("n"), F.asc("doc_id")).select("decision", "doc_id", "n", "rn")


@query(f"select doc_id, len({Q.tokens('text')})::int n, case when len({Q.tokens('text')}) < 32 then 'too_short' when len({Q.tokens('text')}) > 262144 then 'too_long' end reason from documents where text is not null")
def length_gate(spark, sf):
    n = F.size(X.tokens(F.col("text")))
    return docs(spark, sf).where("text is not null").select("doc_id", n.alias("n")).withColumn("reason", F.expr("case when n < 32 then 'too_short' when n > 262144 then 'too_long' end"))


_STRIP = f"'^[{Q.SPACE}]+|[{Q.SPACE}]+$', '', 'g'"


def _dupes(name: str, of: str) -> str:
    """How many elements of a list stood before, and their characters."""
    return f"(len({of}) - len(list_distinct({of})))::int duplicate_{name}s, {_chars(f'list_filter({of}, lambda x, i: list_position({of}, x) < i)')} duplicate_{name}_chars"


def _chars(of: str) -> str:
    return f"coalesce(list_sum(list_transform({of}, lambda x: length(x))), 0)::int"


_GRAMMED = ", ".join(
    f"a{n} as (select doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') gram, {_chars(f'ws[i:i + {n - 1}]')} size from (select doc_id, ws, unnest(range(1, len(ws) - {n - 2})) i from rt where len(ws) >= {n}))"
    + (f", b{n} as (select doc_id, arg_max(k * (size + {n - 1}), (k, size)) v from (select doc_id, gram, any_value(size) size, count(*) k from a{n} group by 1, 2) group by 1)" if n in L.TOP_GRAMS else
       f", b{n} as (select doc_id, sum(length(ws[place]))::bigint v from (select distinct doc_id, unnest(range(i, i + {n})) place from (select *, min(i) over (partition by doc_id, gram) low from a{n}) where i > low) join rt using (doc_id) group by 1)")
    for n in (*L.TOP_GRAMS, *L.DUPLICATE_GRAMS)
)
_REPETITION = f"""rt as (select doc_id, tx, list_filter(string_split({Q.squeezed('tx')}, ' '), lambda w: w <> '') ws, list_filter(regexp_split_to_array(tx, '\\n{{2,}}'), lambda x: x <> '') ps, list_filter(regexp_split_to_array(tx, '\\n+'), lambda x: x <> '') ls from (select doc_id, regexp_replace(text, {_STRIP}) tx from documents where text is not null)), {_GRAMMED},
rs as (select doc_id, length(tx)::int chars, len(ps)::int paragraphs, {_dupes('paragraph', 'ps')}, len(ls)::int all_lines, {_dupes('line', 'ls')}, {', '.join(f'coalesce(b{n}.v, 0)::bigint {k}_{n}' for k, ns in (('top', L.TOP_GRAMS), ('duplicate', L.DUPLICATE_GRAMS)) for n in ns)} from rt {' '.join(f'left join b{n} using (doc_id)' for n in (*L.TOP_GRAMS, *L.DUPLICATE_GRAMS))})"""


def _fineweb(prefix: str, lines: str) -> str:
    own = f"list_filter({lines}, lambda x: regexp_matches(x, '[^{Q.SPACE}]'))"
    ended = r"""'[.!?"''”’]\z'"""
    return f"len({own})::int {prefix}_lines, len(list_filter({own}, lambda x: regexp_matches(x, {ended})))::int {prefix}_ended, len(list_filter({own}, lambda x: length(x) <= 30))::int {prefix}_short, {_chars(own)} - {_chars(f'list_distinct({own})')} {prefix}_duplicate_chars, {_chars(own)} {prefix}_chars"


_CLEAN = f"list_transform(raw, lambda x: regexp_replace(regexp_replace(x, '\\[\\d*\\]|\\[edit\\]|\\[citation needed\\]', '', 'g'), {_STRIP}))"
_LIVE = f"list_filter({_CLEAN}, lambda x: len(regexp_extract_all(x, '[^{Q.SPACE}]+')) >= {L.LINE_WORDS} and len(list_filter(regexp_extract_all(x, '[^{Q.SPACE}]+'), lambda w: length(w) > {L.WORD_LENGTH})) = 0)"
_STATS = f"""t as (select doc_id, text, list_filter(string_split({Q.squeezed('text')}, ' '), lambda w: w <> '') ws, string_split(text, chr(10)) raw, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.squeezed('x')}), lambda x: x <> '') ls from documents where text is not null),
t2 as (select *, {_LIVE} live from t), t3 as (select *, list_filter(live, lambda x: not contains(lower(x), 'javascript')) shown from t2), t4 as (select *, list_filter(shown, lambda x: not regexp_matches(lower(x), '{'|'.join(L.POLICIES)}')) kept from t3),
st as (select doc_id, len(ws)::int words, len(ls)::int lines, length(array_to_string(ws, '')) / greatest(len(ws), 1) mean_word_length, (len(regexp_extract_all(text, '#')) + len(regexp_extract_all(text, '\\.\\.\\.|…')))::int symbols,
len(list_filter(ls, lambda x: regexp_matches(x, '^[•‣▪◦*–-]')))::int bullet_lines, len(list_filter(ls, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)$')))::int ellipsis_lines, len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}')))::int alpha_words,
len(list_intersect(list_distinct(list_transform(ws, lambda w: lower(w))), ['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with']))::int stop_words,
len(list_filter(live, lambda x: contains(lower(x), 'lorem ipsum'))) > 0 lorem, len(list_filter(shown, lambda x: contains(x, '{{'))) > 0 curly,
coalesce(list_sum(list_transform(kept, lambda x: greatest(1, len(regexp_extract_all(x, '[.!?…]+["''”’)]*(?:\\s|$)'))))), 0)::int sentences, len(kept)::int kept_lines,
{_fineweb('fineweb', 'raw')}, {_fineweb('rstrip', f"list_transform(raw, lambda x: regexp_replace(x, '[{Q.SPACE}]+$', ''))")}, {_fineweb('after_c4', 'kept')} from t4)"""


def _failing(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {rule} then '{n}' end" for n, rule in rules.items()) + "], lambda v: v is not null)"


_C4_OK = f"len({_failing(L.C4)}) = 0"
_FAILED = f"list_concat({_failing(L.REPETITION | L.QUALITY | L.C4)}, case when {_C4_OK} then {_failing(L.fineweb('after_c4'))} else [] end)"


def _chained(spark, sf):
    return repetition_statistics(spark, sf).join(chain_statistics(spark, sf), "doc_id")


@query(f"with {_REPETITION} select * from rs")
def repetition_statistics(spark, sf):
    """The counts behind the published rules on repetition."""
    return L.repetition_statistics(spread(docs(spark, sf)), "doc_id", "text")


@query(f"with {_STATS} select * from st")
def chain_statistics(spark, sf):
    """The counts behind the published quality rules."""
    return L.chain_statistics(spread(docs(spark, sf)), "doc_id", "text")


@query(f"with {_REPETITION}, {_STATS}, ch as (select doc_id, {_FAILED} failed from st join rs using (doc_id)) select doc_id, failed, failed[1] first_failure from ch")
def quality_chain(spark, sf):
    """Every rule that a document fails, and the first of the chain: repetition, quality, C4, FineWeb on C4's text."""
    return L.chain(_chained(spark, sf), "doc_id")


@query(f"with {_REPETITION}, {_STATS}, ch as (select {_FAILED}[1] first_failure from st join rs using (doc_id)) select coalesce(first_failure, 'pass') first_failure, count(*) documents from ch group by 1")
def chain_hist(spark, sf):
    """Documents by the first rule of the chain that they fail."""
    return quality_chain(spark, sf).groupBy(F.coalesce("first_failure", F.lit("pass")).alias("first_failure")).agg(F.count("*").alias("documents"))


_ALONE = ", ".join(f"{{'stage': '{n}', 'reason': {f'case when {_C4_OK} then {_failing(r)}[1] end' if n == 'fineweb_after_c4' else f'{_failing(r)}[1]'}}}" for n, r in L.STAGES.items())


@query(f"with {_REPETITION}, {_STATS}, al as (select unnest([{_ALONE}]) s from st join rs using (doc_id)) select s.stage stage, s.reason reason, count(*) documents from al where s.reason is not null group by 1, 2")
def chain_independent(spark, sf):
    """Documents by the first rule that they fail of each stage by itself, FineWeb on three forms of the text."""
    return L.independent(_chained(spark, sf), "doc_id").groupBy("stage", "reason").agg(F.count("*").alias("documents"))


@query(f"""with t as (select doc_id, {Q.tokens('text')} ws from documents where text is not null), p as (select doc_id, ws, unnest(range(1, least(13, len(ws) // 3) + 1)) period from t where len(ws) >= 3),
b as (select doc_id, period, unnest(range(period + 1, len(ws) + 1)) i, unnest(list_transform(range(period + 1, len(ws) + 1), lambda k: ws[k] = ws[k - period])) same from p), r as (select doc_id, period, i - row_number() over (partition by doc_id, period order by i) g from b where same)
select doc_id, period::int period, (count(*) + period) // period times from r group by doc_id, period, g having (count(*) + period) // period >= 3""")
def periodic(spark, sf):
    """Stretches of words that repeat with a short period."""
    d = spread(docs(spark, sf)).where("text is not null").select("doc_id", X.tokens(F.col("text")).alias("ws"))
    return L.periodic(d, "doc_id", "ws")


_PERIODIC_SQL = QUERIES_SQL["periodic"]


@query(f"with pr as ({_PERIODIC_SQL}) select doc_id, max(times) times from pr group by 1 having max(times) >= 32")
def periodic_rejected(spark, sf):
    """Documents with a stretch that repeats 32 times or more, to be left out."""
    return L.periodic_rejected(periodic(spark, sf), "doc_id")


#: Terms of each topic, and how many different ones make a hit: parameters of a small table.
TOPICS = {"astronomy": ["planet", "orbit", "telescope", "comet", "galaxy"], "money": ["bank", "loan", "tax", "budget", "market"], "school": ["teacher", "pupil", "lesson", "exam", "homework"], "chemistry": ["acid", "solvent", "molecule", "catalyst", "per cent"]}
_TERMS = "(values " + ", ".join(f"('{t}', '{w}')" for t, ws in TOPICS.items() for w in ws) + ") v(topic, term)"
_HITS = f"h as (select d.doc_id, v.topic, count(*) hits from (select doc_id, ' ' || {Q.body('text')} || ' ' b from documents where text is not null) d join {_TERMS} on contains(d.b, ' ' || v.term || ' ') group by 1, 2 having count(*) >= 2)"


def _topics(spark, sf):
    found = F.array_compact(F.array(*(F.when(F.contains("b", F.lit(f" {w} ")), F.lit(t)) for t, ws in TOPICS.items() for w in ws)))
    d = docs(spark, sf).where("text is not null").select("doc_id", F.concat(F.lit(" "), X.body(F.col("text")), F.lit(" ")).alias("b"))
    return d.select("doc_id", F.explode(found).alias("topic")).groupBy("doc_id", "topic").agg(F.count("*").alias("hits")).where("hits >= 2")


@query(f"with {_HITS} select doc_id, topic, hits, row_number() over (partition by doc_id order by hits desc, topic) as place from h")
def topic_retrieve(spark, sf):
    """Topics of which a document has two terms or more; phrases count as terms."""
    return ordered.top(_topics(spark, sf), len(TOPICS), ["doc_id"], F.desc("hits"), F.asc("topic")).select("doc_id", "topic", "hits", F.col("rn").alias("place"))


@query(f"with {_HITS} select topic, doc_id, hits, rn from (select *, row_number() over (partition by topic order by hits desc, doc_id) rn from h) where rn <= 5")
def topk_topic(spark, sf):
    """The five best documents of each topic."""
    return ordered.top(_topics(spark, sf), 5, ["topic"], F.desc("hits"), F.asc("doc_id")).select("topic", "doc_id", "hits", "rn")


@query("select token_sha, count(*) copies, min(record_id) first_id, list_sort(list(distinct source_shard)) shards from records where token_sha is not null group by 1 order by copies desc, token_sha limit 20")
def top_copied(spark, sf):
    """The 20 contents with most copies."""
    g = table(spark, sf, "records").where("token_sha is not null").groupBy("token_sha")
    best = g.agg(F.count("*").alias("copies")).orderBy(F.desc("copies"), "token_sha").limit(20)
    more = table(spark, sf, "records").join(F.broadcast(best), "token_sha")  # 20 rows
    return more.groupBy("token_sha", "copies").agg(F.min("record_id").alias("first_id"), F.array_sort(F.collect_set("source_shard")).alias("shards"))


@query("with s as (select doc_id, length(text) chars, n_chars, length(text) - length(replace(text, chr(10), '')) breaks from documents where text is not null), r as (select doc_id, row_number() over (order by chars desc, doc_id) a, row_number() over (order by breaks desc, doc_id) b, row_number() over (order by abs(chars - coalesce(n_chars, 0)) desc, doc_id) c from s) select doc_id from r where a <= 20 or b <= 20 or c <= 20")
def review_set(spark, sf):
    """The union of the first 20 by three measures, each a top-k and not a sort of everything."""
    s = docs(spark, sf).where("text is not null").select("doc_id", F.length("text").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("breaks"), F.abs(F.length("text") - F.coalesce("n_chars", F.lit(0))).alias("off"))
    one = lambda c: s.orderBy(F.desc(c), "doc_id").limit(20).select("doc_id")
    return one("chars").union(one("breaks")).union(one("off")).distinct()


@query("select doc_id, length(text)::int chars from documents where contains(text, 'mountain') or contains(text, 'lesson')")
def substring_search(spark, sf):
    return docs(spark, sf).where(F.contains("text", F.lit("mountain")) | F.contains("text", F.lit("lesson"))).select("doc_id", F.length("text").alias("chars"))


def _search_norm(text: str) -> str:
    return f"regexp_replace({Q.replaced(f'nfc_normalize({text})', [*Q.ESCAPES, ('``', chr(34)), (chr(39) * 4, chr(34)), ('“', chr(34)), ('”', chr(34)), ('’', chr(39) * 2)])}, '[{Q.SPACE}]+', '', 'g')"


def search_normal(text):
    """NFC, brackets and quotes as plain marks, no white space."""
    table_ = {**X.BRACKETS, "``": '"', "''": '"', "“": '"', "”": '"', "’": "'"}
    return F.regexp_replace(X.replaced(X.nfc(text), table_), f"[{X.SPACE}]+", "")


@query(f"select doc_id, sha256({_search_norm('text')}) norm_sha from documents where text is not null")
def search_norm(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", F.sha2(search_normal(F.col("text")), 256).alias("norm_sha"))


@query(f"with i as (select item_id, {_search_norm('passage')} p, ' ' || array_to_string({Q.tokens('passage')}[1:5], ' ') || ' ' anchor from eval_items where passage is not null and len({Q.tokens('passage')}) >= 5), d as (select doc_id, {_search_norm('text')} t, ' ' || {Q.body('text')} || ' ' b from documents where text is not null) select item_id, doc_id from i join d on contains(d.b, i.anchor) and contains(d.t, i.p)")
def anchored_search(spark, sf):
    """Documents that hold an item's whole passage, white space aside. The passage's first five words
    are the cheap anchor, an equi-join on their hash; the texts come in for its hits alone."""
    w = X.tokens(F.col("passage"))
    items = table(spark, sf, "eval_items").where("passage is not null").select("item_id", search_normal(F.col("passage")).alias("p"), F.when(F.size(w) >= 5, F.xxhash64(F.array_join(F.slice(w, 1, 5), " "))).alias("anchor")).where("anchor is not null")
    d = docs(spark, sf).where("text is not null")
    g = d.select("doc_id", F.explode(X.grams(X.tokens(F.col("text")), 5)).alias("gram")).select("doc_id", F.xxhash64("gram").alias("anchor"))
    hits = g.join(items.select("item_id", "anchor"), "anchor").select("item_id", "doc_id").distinct()
    texts = d.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", search_normal(F.col("text")).alias("t"))
    return hits.join(texts, "doc_id").join(items.select("item_id", "p"), "item_id").where(F.contains("t", F.col("p"))).select("item_id", "doc_id")
