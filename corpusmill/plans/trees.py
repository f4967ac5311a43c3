"""Queries over parse forests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.text import brackets
from corpusmill.operators import binary as B
from corpusmill.operators import ordered
from corpusmill.operators import trees as T
from corpusmill.operators.packing import greedy_chunks
from corpusmill.plans import sql as Q
from corpusmill.plans.registry import query, table

_EV = r"""p as (select parse_id, min(parsed) parsed from parses where parsed is not null group by 1),
t as (select parse_id, unnest(toks) tok, unnest(range(len(toks))) i from (select parse_id, regexp_extract_all(parsed, '\([^\s()]*|\)|[^\s()]+') toks from p)),
s as (select *, case when tok[1] = '(' then 1 when tok = ')' then -1 else 0 end step from t),
ev as (select *, sum(step) over (partition by parse_id order by i)::int depth, coalesce(lead(step) over (partition by parse_id order by i) = 0, false) next_leaf, coalesce(lag(step) over (partition by parse_id order by i) = 0, false) prev_leaf from s),
bal as (select parse_id, count(*) tokens, count_if(step = 1)::bigint opens, count_if(step = -1)::bigint closes, count_if(step = 1 and depth = 1)::bigint roots, min(depth) >= 0 and arg_max(depth, i) = 0 balanced from ev group by 1)"""
_TY = _EV + """,
lv as (select *, case when step = -1 then depth + 1 else depth end level from ev where parse_id in (select parse_id from bal where balanced)),
ty as (select *, last_value(case when step = 1 then tok[2:] end ignore nulls) over w as label, last_value(case when step = 1 then i end ignore nulls) over w as open_at from lv window w as (partition by parse_id, level order by i))"""
_LIN = (
    _TY
    + f""",
mk as (select parse_id, i, case when step = 0 then {Q.replaced('tok')} when step = 1 and not next_leaf then '<(' || label || '>' when step = -1 and not prev_leaf then '<' || label || ')>' end mark from ty),
lin as (select parse_id, list(mark order by i) tree from mk where mark is not null group by 1)"""
)
_O, _C = "(t[1:2] = '<(' and t[-1:] = '>')", "(t[1:1] = '<' and t[-2:] = ')>')"


def _parses(spark, sf):
    return table(spark, sf, "parses")


def _lin(spark, sf):
    return T.linearized(_parses(spark, sf))


@query(f"with {_EV} select * from bal")
def tree_balance(spark, sf):
    """Tokens, brackets, roots and balance of each forest."""
    return T.balance(T.events(_parses(spark, sf)))


@query(f"with {_LIN} select * from lin")
def linearize(spark, sf):
    return _lin(spark, sf)


@query(f"with {_LIN} select parse_id, list_filter(tree, lambda t: not {_O} and not {_C}) terminal, len(terminal) n from lin")
def proj_terminal(spark, sf):
    return _lin(spark, sf).select("parse_id", T.terminal(F.col("tree")).alias("terminal")).withColumn("n", F.size("terminal").cast("bigint"))


@query(f"with {_LIN} select parse_id, flatten(list_transform(tree, lambda t: case when {_C} then [t, t] else [t] end)) tg from lin")
def proj_tg(spark, sf):
    return _lin(spark, sf).select("parse_id", T.closes_times(F.col("tree"), 2).alias("tg"))


@query(f"with {_LIN} select parse_id, list_filter(tree, lambda t: not {_O}) noont from lin")
def var_noont(spark, sf):
    return _lin(spark, sf).select("parse_id", T.without_opens(F.col("tree")).alias("noont"))


@query(f"with {_LIN} select parse_id, list_transform(list_filter(tree, lambda t, i: not {_C} or i = 1 or not (tree[i - 1][1:1] = '<' and tree[i - 1][-2:] = ')>')), lambda t: case when {_C} then '<)>' else t end) compressed from lin")
def var_compress(spark, sf):
    return _lin(spark, sf).select("parse_id", T.compressed(F.col("tree")).alias("compressed"))


@query(f"with {_LIN} select parse_id, flatten(list_transform(tree, lambda t: case when {_C} then [t, t, t] else [t] end)) triple from lin")
def var_triple(spark, sf):
    return _lin(spark, sf).select("parse_id", T.closes_times(F.col("tree"), 3).alias("triple"))


@query(f"with {_LIN}, m as (select parse_id, list_filter(tree, lambda t: not {_O} and not {_C}) x from lin) select parse_id, flatten(list_transform(x, lambda t, i: case when i % 4 = 0 then [t, '<pause>', '<pause>'] else [t] end)) paused, len(x) + len(x) // 4 * 2 expected from m")
def pause_insert(spark, sf):
    """Two pauses after every four leaves, and the length in closed form."""
    x = T.terminal(F.col("tree"))
    return _lin(spark, sf).select("parse_id", T.pauses(x, 2, 4).alias("paused"), (F.size(x) + F.floor(F.size(x) / 4) * 2).cast("bigint").alias("expected"))


@query(f"with {_LIN} select parse_id, list_concat(['<s>'], tree, ['</s>']) framed from lin")
def frame_docs(spark, sf):
    return _lin(spark, sf).select("parse_id", T.framed(T.framed(F.col("tree"))).alias("framed"))


def _spans(ty: str, name: str = "sp", of: str = "ty") -> str:
    """Spans of phrases from typed rows: grouped by where a bracket opens, without a join of openings and closings."""
    return f"""{ty}, {name}lf as (select *, sum((step = 0)::int) over (partition by parse_id order by i)::int leaves from {of}), {name}op as (select parse_id, open_at, min(case when step = 1 then leaves end) l, max(case when step = -1 then leaves - 1 end) r, max(level) as level, min(label) as label, bool_or(case when step = 1 then next_leaf else prev_leaf end) pre from {name}lf where step <> 0 group by 1, 2),
{name}fi as (select parse_id, level - 1 as level, l, max(r) s from {name}op where r >= l group by 1, 2, 3), {name} as (select o.parse_id, o.label, o.l, coalesce(f.s, o.r) s, o.r from {name}op o left join {name}fi f on f.parse_id = o.parse_id and f.level = o.level and f.l = o.l where not o.pre and o.r >= o.l)"""


@query(f"with {_spans(_TY)} select * from sp")
def tree_spans(spark, sf):
    """Label, ends and split of each phrase."""
    return T.spans(_parses(spark, sf))


@query(f"with {_spans(_TY)} select parse_id, r k, j, least(count(*), 127)::int depth from (select parse_id, r, unnest(range(l, r + 1)) j from sp) group by 1, 2, 3")
def depth_matrix(spark, sf):
    """How many spans that end at leaf k hold leaf j, in the lower triangle, 127 at most."""
    sp = T.spans(_parses(spark, sf)).select("parse_id", F.col("r").alias("k"), F.explode(F.sequence("l", "r")).alias("j"))
    return sp.groupBy("parse_id", "k", "j").agg(F.least(F.count("*"), F.lit(127)).cast("int").alias("depth"))


@query(f"with {_TY}, r as (select parse_id, i, row_number() over (partition by parse_id order by i) - 1 sentence, lead(i) over (partition by parse_id order by i) next_i from ty where step = 1 and depth = 1) select parse_id, sentence, case when sentence = 0 then 0 else i end first_tok, coalesce(next_i - 1, (select max(i) from ty where ty.parse_id = r.parse_id)) last_tok from r")
def sentence_bounds(spark, sf):
    """Token bounds of each tree of a forest; the first has what stands before it, the last what follows."""
    rows = T.typed(T.events(_parses(spark, sf)))
    end = rows.groupBy("parse_id").agg(F.max("i").alias("end"))
    w = Window.partitionBy("parse_id").orderBy("i")
    r = rows.where("step = 1 and depth = 1").select("parse_id", "i", (F.row_number().over(w) - 1).alias("sentence"), F.lead("i").over(w).alias("next_i"))
    return r.join(end, "parse_id").select("parse_id", "sentence", F.when(F.col("sentence") == 0, 0).otherwise(F.col("i")).alias("first_tok"), F.coalesce(F.col("next_i") - 1, F.col("end")).alias("last_tok"))


@query(r"select parse_id, any_value(regexp_replace(regexp_replace(parsed, '\(ADJ([ )])', '(ADJP\1', 'g'), '\(\s*[^\s()]*\s*\)', '', 'g')) repaired, any_value(len(regexp_extract_all(parsed, '\(ADJ[ )]'))) renamed, any_value(len(regexp_extract_all(regexp_replace(parsed, '\(ADJ([ )])', '(ADJP\1', 'g'), '\(\s*[^\s()]*\s*\)'))) emptied from (select parse_id, min(parsed) parsed from parses where parsed is not null group by 1) group by 1")
def label_repair(spark, sf):
    """The label ADJ as ADJP, empty nodes removed, with the numbers of repairs."""
    p = _parses(spark, sf).where("parsed is not null").groupBy("parse_id").agg(F.min("parsed").alias("parsed"))
    fixed = F.regexp_replace("parsed", r"\(ADJ([ )])", "(ADJP$1")
    empty = r"\(\s*[^\s()]*\s*\)"
    return p.select("parse_id", F.regexp_replace(fixed, empty, "").alias("repaired"), F.regexp_count("parsed", F.lit(r"\(ADJ[ )]")).cast("bigint").alias("renamed"), F.regexp_count(fixed, F.lit(empty)).cast("bigint").alias("emptied"))


@query(rf"select parse_id, list_transform(regexp_extract_all(parsed, '\(([^\s()]+) ([^\s()]+)\)', 2), lambda x: {Q.replaced('x')}) leaves from (select parse_id, min(parsed) parsed from parses where parsed is not null group by 1)")
def parse_leaves(spark, sf):
    """Leaves of preterminals, with bracket escapes read."""
    p = _parses(spark, sf).where("parsed is not null").groupBy("parse_id").agg(F.min("parsed").alias("parsed"))
    return p.select("parse_id", F.transform(F.regexp_extract_all("parsed", F.lit(r"\(([^\s()]+) ([^\s()]+)\)"), F.lit(2)), brackets).alias("leaves"))


_SPANS = f"with {_spans(_TY)}"


@query(_SPANS + ", sd as (select parse_id, min(source_shard) >= 'crawl-shard-030' reserved from parses group by 1) select label, l, r, sum(case when reserved then 1 else -1 end)::bigint diff from sp join sd using (parse_id) group by 1, 2, 3 having sum(case when reserved then 1 else -1 end) <> 0")
def span_diff(spark, sf):
    """Multiset difference of the labelled spans of reserved and historical shards."""
    reserved = _parses(spark, sf).groupBy("parse_id").agg((F.min("source_shard") >= "crawl-shard-030").alias("reserved"))
    sp = T.spans(_parses(spark, sf)).join(reserved, "parse_id").groupBy("label", "l", "r").agg(F.sum(F.when(F.col("reserved"), 1).otherwise(-1)).alias("diff"))
    return sp.where("diff <> 0")


@query(_SPANS + " select label, count(*) spans, sum(r - l + 1)::bigint leaves, min(r - l + 1) shortest, max(r - l + 1) longest, count_if(l = r)::bigint / count(*) single_rate from sp group by 1")
def span_audit(spark, sf):
    n = F.col("r") - F.col("l") + 1
    return T.spans(_parses(spark, sf)).groupBy("label").agg(F.count("*").alias("spans"), F.sum(n).alias("leaves"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.try_divide(F.count_if(n == 1), F.count("*")).alias("single_rate"))


@query(f"with recursive {_LIN}, m as (select parse_id, len(list_filter(tree, lambda t: not {_O} and not {_C})) n, row_number() over (order by parse_id) k from lin), g as (select k, parse_id, n, n total, 1 chunk from m where k = 1 union all select m.k, m.parse_id, m.n, case when g.total + m.n <= 256 then g.total + m.n else m.n end, case when g.total + m.n <= 256 then g.chunk else g.chunk + 1 end from g join m on m.k = g.k + 1) select parse_id, chunk::bigint chunk from g")
def pack_greedy(spark, sf):
    """Whole forests in order into chunks of at most 256 leaves; a longer one is alone."""
    sizes = _lin(spark, sf).select("parse_id", F.size(T.terminal(F.col("tree"))).alias("n"))
    return greedy_chunks(sizes, "parse_id", "n", 256)


@query(f"with {_LIN}, u as (select parse_id, unnest(tree) t from lin) select t as marker, count(*) n, count(distinct parse_id) forests from u where {_O.replace('t[', 'u.t[')} or {_C.replace('t[', 'u.t[')} group by 1")
def marker_counts(spark, sf):
    u = _lin(spark, sf).select("parse_id", F.explode("tree").alias("marker"))
    return u.where(~T.is_leaf(F.col("marker"))).groupBy("marker").agg(F.count("*").alias("n"), F.countDistinct("parse_id").alias("forests"))


@query(f"with {_LIN}, u as (select parse_id, unnest(tree) t, unnest(range(len(tree))) pos from lin), v as (select marker, row_number() over (order by marker) + 60000 id from (select distinct t marker from u where {_O.replace('t[', 'u.t[')} or {_C.replace('t[', 'u.t[')})) select u.parse_id, list(coalesce(v.id, ('0x' || sha256(u.t)[1:4])::bigint % 50000) order by pos) ids from u left join v on v.marker = u.t group by 1")
def encode_markers(spark, sf):
    """Markers as ids from 60001 in order of their text, leaves as hashes below 50000."""
    u = _lin(spark, sf).select("parse_id", F.posexplode("tree").alias("pos", "t"))
    v = ordered.numbered(u.where(~T.is_leaf(F.col("t"))).select("t").distinct(), ["t"]).select("t", (F.col("rn") + 60000).alias("id"))
    leaf = F.conv(F.substring(F.sha2("t", 256), 1, 4), 16, 10).cast("bigint") % 50000
    x = u.join(v, "t", "left").groupBy("parse_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", leaf).alias("id")))).alias("x"))
    return x.select("parse_id", F.transform("x", lambda y: y["id"]).alias("ids"))


@query(None)
def binarize(spark, sf):
    """Nodes of the right-branching binary tree of each forest, in post-order."""
    return B.binarized(_lin(spark, sf), "parse_id", "tree")


@query(None)
def merge_order(spark, sf):
    return B.merge_order(_lin(spark, sf), "parse_id", "tree")


@query(None)
def marker_shuffle(spark, sf):
    return B.shuffled_markers(_lin(spark, sf), "parse_id", "tree")


@query(f"with {_TY}, lf as (select parse_id, i, tok, depth, sum((step = 0)::int) over (partition by parse_id order by i)::int - 1 leaf, sum((step = 1 and depth = 1)::int) over (partition by parse_id order by i)::int - 1 sentence from ty), x as (select *, step = 0 is_leaf from ty) select lf.parse_id, lf.leaf, lf.sentence, not regexp_matches(lf.tok, '^(n[''’]t|[''’](s|re|ve|ll|d|m)|[.,!?;:])$') word_start from lf join x using (parse_id, i) where is_leaf")
def word_starts(spark, sf):
    """Sentence of each leaf, and whether it begins a word (clitics and marks don't)."""
    rows = T.typed(T.events(_parses(spark, sf)))
    w = Window.partitionBy("parse_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    leaf = F.sum(F.when(F.col("step") == 0, 1).otherwise(0)).over(w) - 1
    sentence = F.sum(F.when((F.col("step") == 1) & (F.col("depth") == 1), 1).otherwise(0)).over(w) - 1
    rows = rows.withColumns({"leaf": leaf, "sentence": sentence}).where("step = 0")
    return rows.select("parse_id", "leaf", "sentence", (~F.col("tok").rlike(r"^(n['’]t|['’](s|re|ve|ll|d|m)|[.,!?;:])$")).alias("word_start"))


@query(f"with {_TY} select parse_id, label, count(*) n, max(level)::int deepest from ty where step = 1 and not next_leaf group by 1, 2")
def label_depths(spark, sf):
    """Phrases of each label and their greatest depth in each forest."""
    rows = T.typed(T.events(_parses(spark, sf))).where("step = 1 and not next_leaf")
    return rows.groupBy("parse_id", "label").agg(F.count("*").alias("n"), F.max("level").cast("int").alias("deepest"))


#: Each forest as it is, without its last token, with its markers' labels crossed, and reversed.
_VARIANTS = f"vr as (select parse_id, unnest([{{{{'k': 'whole', 't': tree}}}}, {{{{'k': 'cut', 't': tree[1:len(tree) - 1]}}}}, {{{{'k': 'crossed', 't': list_concat(['<(X>', '<(Y>'], tree, ['<X)>', '<Y)>'])}}}}, {{{{'k': 'reversed', 't': list_reverse(tree)}}}}]) x from lin)".replace("{{", "{").replace("}}", "}")


@query(f"""with recursive {_LIN}, {_VARIANTS}, vm as (select parse_id, x.k kind, list_filter(x.t, lambda t: {_O} or {_C}) ms from vr),
st as (select parse_id, kind, ms, 0 i, []::varchar[] open, 0 dep, 0 roots, true ok from vm union all
select parse_id, kind, ms, i + 1, case when ms[i + 1][1:2] = '<(' then list_append(open, ms[i + 1][3:-2]) else open[1:len(open) - 1] end, dep + case when ms[i + 1][1:2] = '<(' then 1 else -1 end, roots + (ms[i + 1][1:2] = '<(' and dep = 0)::int, ok and (ms[i + 1][1:2] = '<(' or (len(open) > 0 and open[len(open)] = ms[i + 1][2:-3])) from st where i < len(ms))
select parse_id, kind, len(ms) markers, roots, ok and len(open) = 0 valid from st where i = len(ms)""")
def typed_balance(spark, sf):
    """Pairs and labels of the markers of each linearized forest, and of damaged forms of it. The SQL walks
    with a stack."""
    k = lambda n, t: F.struct(F.lit(n).alias("kind"), t.alias("tree"))
    x = F.col("tree")
    crossed = F.concat(F.array(F.lit("<(X>"), F.lit("<(Y>")), x, F.array(F.lit("<X)>"), F.lit("<Y)>")))
    v = _lin(spark, sf).select("parse_id", F.explode(F.array(k("whole", x), k("cut", F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))), k("crossed", crossed), k("reversed", F.reverse(x)))).alias("v")).select(F.struct("parse_id", "v.kind").alias("id"), "v.tree")
    return T.typed_balance(v, "id", "tree").select("id.parse_id", "id.kind", "markers", "roots", "valid")


@query(None)
def binarize_left(spark, sf):
    """Nodes of the left-branching binary tree of each forest, in post-order."""
    return B.binarized(_lin(spark, sf), "parse_id", "tree", left=True)


@query(None)
def merge_order_left(spark, sf):
    return B.merge_order(_lin(spark, sf), "parse_id", "tree", left=True)


@query(f"with {_LIN} select parse_id, tree from lin")
def tg_inverse(spark, sf):
    """The tg form taken back: each pair of closing markers as one."""
    return B.undoubled(_lin(spark, sf).select("parse_id", T.closes_times(F.col("tree"), 2).alias("tree")), "parse_id", "tree")


@query(f"with {_LIN} select parse_id, list_concat(tree, ['</s>']) tree from lin")
def inner_eos_depth(spark, sf):
    """End marks taken out inside trees (one is put behind every opening marker here) and kept at the end."""
    put = F.flatten(F.transform("tree", lambda t: F.when(T.is_open(t), F.array(t, F.lit("</s>"))).otherwise(F.array(t))))
    return B.without_inner(_lin(spark, sf).select("parse_id", F.concat(put, F.array(F.lit("</s>"))).alias("tree")), "parse_id", "tree")


@query(f"with {_LIN}, pz as (select parse_id, list_filter(tree, lambda t: not {_O} and not {_C}) x from lin) select parse_id, x restored, list_transform(range(len(x) + len(x) // 4 * 2), lambda i: i % 6 >= 4) mask, len(x) + case when len(x) > 0 and len(x) % 4 = 0 then len(x) // 4 * 2 - 2 else len(x) // 4 * 2 end trimmed from pz")
def pause_inverse(spark, sf):
    """The mask of inserted pauses, the array without them, and its length without those at the end."""
    d = _lin(spark, sf).select("parse_id", T.pauses(T.terminal(F.col("tree")), 2, 4).alias("x"))
    return d.select("parse_id", T.unpaused(F.col("x"), 2, 4).alias("restored"), T.pause_mask(F.col("x"), 2, 4).alias("mask"), F.size(T.without_last_pauses(F.col("x"))).cast("bigint").alias("trimmed"))


@query(f"with {_LIN}, v as (select parse_id, unnest(['plain', 'framed', 'twice', 'inside']) kind, tree from lin) select parse_id, kind, case kind when 'twice' then 'misplaced <s>' when 'inside' then 'misplaced </s>' end error from v")
def frame_errors(spark, sf):
    """Markers in the wrong place: forests without markers, framed, with two at the front, and with one inside."""
    x, bos, eos = F.col("tree"), F.array(F.lit("<s>")), F.array(F.lit("</s>"))
    forms = {"plain": x, "framed": F.concat(bos, x, eos), "twice": F.concat(bos, bos, x, eos), "inside": F.concat(bos, F.slice(x, 1, 1), eos, x, eos)}
    v = _lin(spark, sf).select("parse_id", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), t.alias("t")) for n, t in forms.items()))).alias("v")).select("parse_id", "v.*")
    return v.select("parse_id", "kind", T.frame_error(F.col("t")).alias("error"))


@query(rf"with {_LIN}, le as (select parse_id, list_filter(tree, lambda t: not {_O} and not {_C}) a from lin), rx as (select parse_id, list_transform(regexp_extract_all(parsed, '\([^\s()]*|\)|[^\s()]+'), lambda t: t) toks from p), raw as (select parse_id, list_transform(list_filter(toks, lambda t: t[1] <> '(' and t <> ')'), lambda x: {Q.replaced('x')}) b from rx), pl as (select parse_id, min(source_shard) s, min(source_row) r from parses group by 1) select le.parse_id, a = b same_leaves, exists(select 1 from documents d where d.source = s and d.source_row = r) paired from le join raw using (parse_id) join pl using (parse_id)")
def pair_proof(spark, sf):
    """Whether the projection of a tree onto its leaves is the text of the parse, and a document is at its place."""
    lv = _lin(spark, sf).select("parse_id", T.terminal(F.col("tree")).alias("a"))
    p = _parses(spark, sf).where("parsed is not null").groupBy("parse_id").agg(F.min("parsed").alias("parsed"))
    toks = F.filter(F.regexp_extract_all("parsed", F.lit(T.TOKEN), F.lit(0)), lambda t: ~t.startswith("(") & (t != ")"))
    raw = p.select("parse_id", F.transform(toks, brackets).alias("b"))
    place = _parses(spark, sf).groupBy("parse_id").agg(F.min("source_shard").alias("source"), F.min("source_row").alias("source_row"))
    d = table(spark, sf, "documents").select("source", "source_row").distinct().withColumn("there", F.lit(True))
    return lv.join(raw, "parse_id").join(place, "parse_id").join(d, ["source", "source_row"], "left").select("parse_id", (F.col("a") == F.col("b")).alias("same_leaves"), F.coalesce("there", F.lit(False)).alias("paired"))


_NEW = "pn as (select parse_id, regexp_replace(parsed, '\\(NP([ )])', '(NX\\1', 'g') parsed from p where parse_id % 2 = 0 union all select parse_id, parsed || ' (S (X end))' from p where parse_id % 2 = 1)"


def _version(ev: str) -> str:
    """The typed rows of another version of the forests, whose texts are pn's."""
    names = ("t", "s", "ev", "bal", "lv", "ty")
    body = ev[ev.index("t as (") :].replace("from p)", "from pn)")
    for n in names:
        body = body.replace(f"\n{n} as (", f"\n{n}2 as (").replace(f"from {n} ", f"from {n}2 ").replace(f"from {n})", f"from {n}2)")
    return body.replace("t as (select parse_id, unnest(toks)", "t2 as (select parse_id, unnest(toks)").replace("from bal where", "from bal2 where").replace("from t)", "from t2)").replace("from ev group", "from ev2 group").replace("from lv window", "from lv2 window")


@query(f"""with {_spans(_TY)}, {_NEW}, {_spans(_version(_TY), 'sq', 'ty2')}, oc as (select parse_id, label, l, r, count(*) n from sp group by 1, 2, 3, 4), nc as (select parse_id, label, l, r, count(*) n from sq group by 1, 2, 3, 4),
j as (select coalesce(a.parse_id, b.parse_id) parse_id, coalesce(a.l, b.l) l, coalesce(a.r, b.r) r, coalesce(a.n, 0) o, coalesce(b.n, 0) w from oc a full join nc b on a.parse_id = b.parse_id and a.label = b.label and a.l = b.l and a.r = b.r),
u as (select parse_id, l, r, sum(o) o, sum(w) w from j group by 1, 2, 3), k as (select parse_id, bool_and(o = w) same from j group by 1), v as (select parse_id, bool_and(o = w) same_spans, bool_and((o > 0) = (w > 0)) same_kinds from u group by 1)
select case when same then 'serialization_only' when same_spans then 'label_only' when same_kinds then 'unary_multiplicity' else 'changed_spans' end kind, count(*) forests from k join v using (parse_id) group by 1""")
def span_changes(spark, sf):
    """Two versions of the forests by what changed: nothing, labels, the number of phrases over the same leaves,
    or spans. (The new version has a label renamed in even forests and a tree more in odd ones.)"""
    old, new = _versions(spark, sf)
    n = lambda d, name: d.groupBy("parse_id", "label", "l", "r").agg(F.count("*").alias(name))
    j = n(T.spans(old), "o").join(n(T.spans(new), "w"), ["parse_id", "label", "l", "r"], "full_outer").fillna(0, ["o", "w"])
    u = j.groupBy("parse_id", "l", "r").agg(F.sum("o").alias("o"), F.sum("w").alias("w"))
    k = j.groupBy("parse_id").agg(F.bool_and(F.col("o") == F.col("w")).alias("same"))
    v = u.groupBy("parse_id").agg(F.bool_and(F.col("o") == F.col("w")).alias("same_spans"), F.bool_and((F.col("o") > 0) == (F.col("w") > 0)).alias("same_kinds"))
    kind = F.when(F.col("same"), "serialization_only").when(F.col("same_spans"), "label_only").when(F.col("same_kinds"), "unary_multiplicity").otherwise("changed_spans")
    return k.join(v, "parse_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("forests"))


def _versions(spark, sf):
    p = _parses(spark, sf).where("parsed is not null").groupBy("parse_id").agg(F.min("parsed").alias("parsed"))
    new = F.when(F.col("parse_id") % 2 == 0, F.regexp_replace("parsed", r"\(NP([ )])", "(NX$1")).otherwise(F.concat("parsed", F.lit(" (S (X end))")))
    return p, p.select("parse_id", new.alias("parsed"))


@query(f"with {_EV}, rx as (select parse_id, list_transform(regexp_extract_all(parsed, '\\(([^\\s()]+) ([^\\s()]+)\\)', 2), lambda x: {Q.replaced('x')}) a, list_transform(list_filter(regexp_extract_all(parsed, '\\([^\\s()]*|\\)|[^\\s()]+'), lambda t: t[1] <> '(' and t <> ')'), lambda x: {Q.replaced('x')}) b from p) select rx.parse_id, case when coalesce(balanced, false) and a = b then 'nodes' when coalesce(balanced, false) then 'tokens' else 'unbalanced' end how, case when coalesce(balanced, false) then b else [] end leaves from rx left join bal using (parse_id)")
def parse_leaves_checked(spark, sf):
    """Leaves of balanced forests: those of plain preterminals where these are all, else every token that is no
    bracket; unbalanced ones have none and say so."""
    p = _parses(spark, sf).where("parsed is not null").groupBy("parse_id").agg(F.min("parsed").alias("parsed"))
    a = F.transform(F.regexp_extract_all("parsed", F.lit(r"\(([^\s()]+) ([^\s()]+)\)"), F.lit(2)), brackets)
    b = F.transform(F.filter(F.regexp_extract_all("parsed", F.lit(T.TOKEN), F.lit(0)), lambda t: ~t.startswith("(") & (t != ")")), brackets)
    ok = T.balance(T.events(_parses(spark, sf))).select("parse_id", "balanced")
    d = p.select("parse_id", a.alias("a"), b.alias("b")).join(ok, "parse_id", "left").withColumn("ok", F.coalesce("balanced", F.lit(False)))
    how = F.when(F.col("ok") & (F.col("a") == F.col("b")), "nodes").when(F.col("ok"), "tokens").otherwise("unbalanced")
    return d.select("parse_id", how.alias("how"), F.when(F.col("ok"), F.col("b")).otherwise(F.array().cast("array<string>")).alias("leaves"))


@query(None)
def graft(spark, sf):
    """Each forest with the phrase over all of its leaves, if there is one, replaced by a tree of one leaf."""
    put = F.array(*map(F.lit, ("<(X>", "x", "<X)>")))
    return B.graft(_lin(spark, sf).select("parse_id", "tree", T.terminal(F.col("tree")).alias("leaves"), put.alias("put")), "parse_id", "tree", "leaves", "put")
