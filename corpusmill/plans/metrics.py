"""Queries over scores of answer choices and results of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.text import grams, tokens
from corpusmill.operators import metrics as M
from corpusmill.operators import ordered
from corpusmill.plans import sql as Q
from corpusmill.plans.registry import docs, query, table

KEY = ["run_name", "task", "doc_id"]
_S = "s as (select * from choice_scores qualify row_number() over (partition by run_name, task, doc_id, cont_id order by scored_at nulls last, full_score_raw nulls last, term_score_raw nulls last) = 1)"


def _best(score: str, name: str) -> str:
    return f"{name} as (select run_name, task, doc_id, arg_max(cont_id, ({score}, -cont_id)) pred from s where {score} is not null and not isnan({score}) group by 1, 2, 3 having max(cont_id) < count(distinct cont_id))"


def _scores(spark, sf):
    return M.first_delivery(table(spark, sf, "choice_scores"), [*KEY, "cont_id"], "scored_at", "full_score_raw", "term_score_raw")


_LABEL = "lb as (select run_name, task, doc_id, min(label) label from s group by 1, 2, 3)"


def _labels(s):
    return s.groupBy(*KEY).agg(F.min("label").alias("label"))


@query(f"with {_S}, {_LABEL}, {_best('full_score_raw', 'b')}, a as (select run_name, task, count(*) cases, avg((pred = label)::int) accuracy from b join lb using (run_name, task, doc_id) group by 1, 2) select run_name, task, cases, round(accuracy, 9) accuracy from a union all select run_name, '_', sum(cases)::bigint, round(avg(accuracy), 9) from a group by 1")
def rank_accuracy(spark, sf):
    """Accuracy of the best choice by run and task, and the macro mean over tasks."""
    return _accuracy(spark, sf).withColumn("accuracy", F.round("accuracy", 9))


def _accuracy(spark, sf):
    s = _scores(spark, sf)
    b = M.chosen(s, KEY, "cont_id", "full_score_raw").join(_labels(s), KEY)
    return M.with_macro(b, "run_name", "task", (F.col("pred") == F.col("label")).cast("int"), "accuracy")


@query(f"with {_S} select run_name, doc_id, cont_id, round(full_score_raw / n_terminal, 9) per_token, round(-full_score_raw / n_terminal, 9) cross_entropy, round(-full_score_raw / n_terminal * 1.4426950408889634, 9) bits, round(full_score_raw - term_score_raw, 9) pmi, round(-full_score_raw / nullif(octet_length(encode(task || cont_id)), 0) * 1.4426950408889634, 9) bits_per_byte from s where n_terminal > 0 and full_score_raw is not null")
def score_norms(spark, sf):
    """Score variants: by length, cross entropy, bits, against the terminal-only score, and by bytes (of the
    choice's name, as the scores come without its text)."""
    per = F.col("full_score_raw") / F.col("n_terminal")
    return _scores(spark, sf).where("n_terminal > 0 and full_score_raw is not null").select("run_name", "doc_id", "cont_id", F.round(per, 9).alias("per_token"), F.round(-per, 9).alias("cross_entropy"), F.round(-per * 1.4426950408889634, 9).alias("bits"), F.round(F.col("full_score_raw") - F.col("term_score_raw"), 9).alias("pmi"), F.round(-F.col("full_score_raw") / F.octet_length(F.concat("task", F.col("cont_id").cast("string"))) * 1.4426950408889634, 9).alias("bits_per_byte"))


@query(f"""with {_S}, {_LABEL}, {_best('full_score_raw', 'f')}, {_best('term_score_raw', 't')},
g as (select run_name, task, round(sum(nt_score_raw) / nullif(sum(n_nonterminal), 0) - sum(term_score_raw) / nullif(sum(n_terminal), 0), 9) gap from s where nt_score_raw is not null and term_score_raw is not null group by 1, 2)
select run_name, task, count(*) cases, count_if(f.pred <> t.pred)::bigint flips, count_if(f.pred <> t.pred and f.pred = label)::bigint to_correct, count_if(f.pred <> t.pred and t.pred = label)::bigint to_wrong, any_value(gap) gap from f join t using (run_name, task, doc_id) join lb using (run_name, task, doc_id) join g using (run_name, task) group by 1, 2""")
def flip_stats(spark, sf):
    """Answers that differ between the full and the terminal-only score, and the gap of scores a token."""
    s = _scores(spark, sf)
    f = M.chosen(s, KEY, "cont_id", "full_score_raw").withColumnRenamed("pred", "f")
    t = M.chosen(s, KEY, "cont_id", "term_score_raw").withColumnRenamed("pred", "t")
    ratio = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    g = s.where("nt_score_raw is not null and term_score_raw is not null").groupBy("run_name", "task").agg(F.round(ratio("nt_score_raw", "n_nonterminal") - ratio("term_score_raw", "n_terminal"), 9).alias("gap"))
    flip = F.col("f") != F.col("t")
    j = f.join(t, KEY).join(_labels(s), KEY)
    n = j.groupBy("run_name", "task").agg(F.count("*").alias("cases"), F.count_if(flip).alias("flips"), F.count_if(flip & (F.col("f") == F.col("label"))).alias("to_correct"), F.count_if(flip & (F.col("t") == F.col("label"))).alias("to_wrong"))
    return n.join(g, ["run_name", "task"])


@query(f"with {_S}, x as (select *, max(full_score_raw) over (partition by run_name, task, doc_id) m from s where full_score_raw is not null and n_terminal > 0), l as (select run_name, task, doc_id, max(m) + ln(sum(exp(full_score_raw - m))) lse, min(n_terminal) n from x group by 1, 2, 3) select run_name, round(exp(-sum(lse) / sum(n)), 6) ppl, sum(n)::bigint terminals from l group by 1")
def doc_ppl(spark, sf):
    """Perplexity with the candidates of each case summed: exp(-sum of log-sum-exp over tokens)."""
    s = _scores(spark, sf).where("full_score_raw is not null and n_terminal > 0")
    lse = M.log_sum_exp(KEY, "full_score_raw", s).join(s.groupBy(*KEY).agg(F.min("n_terminal").alias("n")), KEY)
    return lse.groupBy("run_name").agg(F.round(F.exp(-F.sum("lse") / F.sum("n")), 6).alias("ppl"), F.sum("n").alias("terminals"))


@query(f"with {_S}, f as (select run_name, count(*) cases, count_if(full_score_raw is not null and not isnan(full_score_raw) and n_terminal > 0)::bigint covered, sum(n_terminal)::bigint terminals, sum(full_score_raw) total from s where cont_id = 0 group by 1) select run_name, cases, covered, covered = cases complete, case when covered = cases then round(exp(-total / terminals), 6) end ppl from f")
def doc_ppl_single(spark, sf):
    """Perplexity of the first candidate alone; null unless every case has a score."""
    ok = F.col("full_score_raw").isNotNull() & ~F.isnan("full_score_raw") & (F.col("n_terminal") > 0)
    f = _scores(spark, sf).where("cont_id = 0").groupBy("run_name").agg(F.count("*").alias("cases"), F.count_if(ok).alias("covered"), F.sum("n_terminal").alias("terminals"), F.sum("full_score_raw").alias("total"))
    full = F.col("covered") == F.col("cases")
    return f.select("run_name", "cases", "covered", full.alias("complete"), F.when(full, F.round(F.exp(-F.col("total") / F.col("terminals")), 6)).alias("ppl"))


@query(f"with {_S}, c as (select run_name, doc_id, task, arg_max(cont_id, (full_score_raw, -cont_id)) k from s where full_score_raw is not null group by 1, 2, 3 having count(*) = 4) select run_name, count(*) complete, round(avg((k <> 0)::int), 9) noncand0 from c group by 1")
def noncand0(spark, sf):
    """Share of complete cases whose best candidate isn't the first."""
    c = _scores(spark, sf).where("full_score_raw is not null").groupBy(*KEY).agg(F.max_by("cont_id", F.struct("full_score_raw", -F.col("cont_id"))).alias("k"), F.count("*").alias("n")).where("n = 4")
    return c.groupBy("run_name").agg(F.count("*").alias("complete"), F.round(F.avg((F.col("k") != 0).cast("int")), 9).alias("noncand0"))


_RESOLVED = "good is not null and bad is not null and not isnan(good) and not isnan(bad) and good <> bad"


@query(f"with {_S}, p as (select run_name, split_part(task, '_', 1) term, task, doc_id, max(case when cont_id = label then full_score_raw end) good, max(case when cont_id <> label then full_score_raw end) bad from s group by 1, 2, 3, 4) select coalesce(run_name, '*') run_name, coalesce(term, '*') term, coalesce(task, '*') task, count(*) pairs, count_if(not coalesce({_RESOLVED}, false))::bigint unresolved, round(count_if({_RESOLVED} and good > bad) / count(*), 9) accuracy from p group by rollup (run_name, term, task)")
def pair_accuracy(spark, sf):
    """Whether the right answer scores strictly above the best wrong one: by task, by the term that tasks
    share, by run, and overall. Ties, NaN and missing scores are unresolved, and not right."""
    good, bad = F.max(F.when(F.col("cont_id") == F.col("label"), F.col("full_score_raw"))), F.max(F.when(F.col("cont_id") != F.col("label"), F.col("full_score_raw")))
    p = _scores(spark, sf).groupBy(*KEY).agg(good.alias("good"), bad.alias("bad")).withColumn("term", F.split_part("task", F.lit("_"), F.lit(1)))
    ok = F.expr(_RESOLVED)
    r = p.rollup("run_name", "term", "task").agg(F.count("*").alias("pairs"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("unresolved"), F.round(F.count_if(ok & (F.col("good") > F.col("bad"))) / F.count("*"), 9).alias("accuracy"))
    return r.select(*(F.coalesce(c, F.lit("*")).alias(c) for c in ("run_name", "term", "task")), "pairs", "unresolved", "accuracy")


#: The inequality over condition scores of each suite; every other suite has the second.
FORMULAS = {"maths_test": "c0 < c1 and c2 < c3"}
OTHER = "c0 + c1 < c2 + c3"


@query(f"with {_S}, p as (select run_name, task, doc_id, max(case when cont_id = 0 then full_score_raw end) c0, max(case when cont_id = 1 then full_score_raw end) c1, max(case when cont_id = 2 then full_score_raw end) c2, max(case when cont_id = 3 then full_score_raw end) c3 from s group by 1, 2, 3), a as (select run_name, task, count(*) cases, avg((case when task = 'maths_test' then c0 < c1 and c2 < c3 else c0 + c1 < c2 + c3 end)::int) accuracy from p where c0 is not null and c1 is not null and c2 is not null and c3 is not null group by 1, 2) select run_name, task, cases, round(accuracy, 9) accuracy from a union all select run_name, '_', sum(cases)::bigint, round(avg(accuracy), 9) from a group by 1")
def suite_formula(spark, sf):
    """Items of each suite that satisfy its formula, and the mean over suites."""
    p = _scores(spark, sf).groupBy(*KEY).pivot("cont_id", [0, 1, 2, 3]).agg(F.max("full_score_raw"))
    p = p.toDF(*KEY, "c0", "c1", "c2", "c3").dropna(subset=["c0", "c1", "c2", "c3"])
    rule = F.expr("case " + " ".join(f"when task = '{t}' then {f}" for t, f in FORMULAS.items()) + f" else {OTHER} end")
    return M.with_macro(p, "run_name", "task", rule.cast("int"), "accuracy").withColumn("accuracy", F.round("accuracy", 9))


_ACC = f"{_S}, {_LABEL}, {_best('full_score_raw', 'b')}, a as (select run_name, task, avg((pred = label)::int) accuracy from b join lb using (run_name, task, doc_id) group by 1, 2)"


@query(rf"with {_ACC}, m as (select regexp_extract(run_name, '^(.*)_seed(\d+)$', 1) model, task, accuracy from a), g as (select model, task, count(*) seeds, avg(accuracy) mean, coalesce(stddev_samp(accuracy), 0) sd from m group by 1, 2) select model, task, seeds, round(mean, 9) mean, round(sd, 9) sd, round(mean - first_value(mean) over (partition by task order by model), 9) delta from g")
def seed_stats(spark, sf):
    """Mean and sample deviation over seeds (0 for one seed), and the difference from the first model's mean."""
    a = _accuracy(spark, sf).where("task <> '_'").withColumn("model", F.regexp_extract("run_name", r"^(.*)_seed(\d+)$", 1))
    g = a.groupBy("model", "task").agg(F.count("*").alias("seeds"), F.avg("accuracy").alias("mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("sd"))
    first = g.groupBy("task").agg(F.min_by("mean", "model").alias("base"))
    return g.join(first, "task").select("model", "task", "seeds", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round(F.col("mean") - F.col("base"), 9).alias("delta"))


#: Seven metrics of cases with both predictions, as functions of sums.
PAIRED = {
    "full_accuracy": lambda s: s["full_right"] / s["cases"], "terminal_accuracy": lambda s: s["term_right"] / s["cases"], "difference": lambda s: (s["full_right"] - s["term_right"]) / s["cases"], "flips": lambda s: s["flip"] / s["cases"],
    "to_correct": lambda s: s["to_correct"] / s["cases"], "to_wrong": lambda s: s["to_wrong"] / s["cases"], "gap": lambda s: s["nt"] / s["n_nt"] - s["term"] / s["n_term"],
}
_SUMS = ["cases", "full_right", "term_right", "flip", "to_correct", "to_wrong", "nt", "n_nt", "term", "n_term"]


def _cases(spark, sf):
    s = _scores(spark, sf)
    f = M.chosen(s, KEY, "cont_id", "full_score_raw").withColumnRenamed("pred", "f")
    t = M.chosen(s, KEY, "cont_id", "term_score_raw").withColumnRenamed("pred", "t")
    g = s.where("nt_score_raw is not null and term_score_raw is not null").groupBy(*KEY).agg(F.sum("nt_score_raw").alias("nt"), F.sum("n_nonterminal").alias("n_nt"), F.sum("term_score_raw").alias("term"), F.sum("n_terminal").alias("n_term"))
    j = f.join(t, KEY).join(_labels(s), KEY).join(g, KEY, "left")
    fr, tr, flip = F.col("f") == F.col("label"), F.col("t") == F.col("label"), F.col("f") != F.col("t")
    n = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return j.select(*KEY, F.lit(1).alias("cases"), n(fr).alias("full_right"), n(tr).alias("term_right"), n(flip).alias("flip"), n(flip & fr).alias("to_correct"), n(flip & tr).alias("to_wrong"), "nt", "n_nt", "term", "n_term")


@query(None)
def bootstrap_ci(spark, sf):
    """Seven metrics by run and task, and their means over tasks, with 95 % intervals over 10,000 paired resamples
    of the cases; tasks are resampled by themselves."""
    return M.bootstrap(_cases(spark, sf), ["run_name", "task"], _SUMS, PAIRED, macro="task")


_CASES = f"""{_S}, {_LABEL}, {_best('full_score_raw', 'f')}, {_best('term_score_raw', 't')}, g as (select run_name, task, doc_id, sum(nt_score_raw) nt, sum(n_nonterminal) n_nt, sum(term_score_raw) tm, sum(n_terminal) n_tm from s where nt_score_raw is not null and term_score_raw is not null group by 1, 2, 3),
cs as (select run_name, task, count(*) n, coalesce(count_if(f.pred = label), 0) fr, coalesce(count_if(t.pred = label), 0) tr, count_if(f.pred <> t.pred) fl, count_if(f.pred <> t.pred and f.pred = label) tc, count_if(f.pred <> t.pred and t.pred = label) tw, sum(nt) nt, sum(n_nt) n_nt, sum(tm) tm, sum(n_tm) n_tm from f join t using (run_name, task, doc_id) join lb using (run_name, task, doc_id) left join g using (run_name, task, doc_id) group by 1, 2),
cm as (select run_name, task, unnest([{{'m': 'full_accuracy', 'v': fr / n}}, {{'m': 'terminal_accuracy', 'v': tr / n}}, {{'m': 'difference', 'v': (fr - tr) / n}}, {{'m': 'flips', 'v': fl / n}}, {{'m': 'to_correct', 'v': tc / n}}, {{'m': 'to_wrong', 'v': tw / n}}, {{'m': 'gap', 'v': nt / nullif(n_nt, 0) - tm / nullif(n_tm, 0)}}]) x from cs)"""


@query(f"with {_CASES} select run_name, task, x.m metric, round(x.v, 9) as value from cm union all select run_name, '_', x.m, round(avg(x.v), 9) from cm group by 1, 3")
def bootstrap_values(spark, sf):
    """bootstrap_ci's values without the intervals, from few resamples."""
    return M.bootstrap(_cases(spark, sf), ["run_name", "task"], _SUMS, PAIRED, samples=10, macro="task").select("run_name", "task", "metric", F.round("value", 9).alias("value"))


_D = "d as (select * from doc_results qualify row_number() over (partition by run_name, document_id order by written_at nulls last, log_likelihood nulls last) = 1)"


def _results(spark, sf):
    return M.first_delivery(table(spark, sf, "doc_results"), ["run_name", "document_id"], "written_at", "log_likelihood")


@query(f"with {_D} select run_name, count(*) documents, sum(sentence_count)::bigint sentences, sum(terminal_count)::bigint terminals, count_if(log_likelihood is null or isnan(log_likelihood))::bigint without_score, round(exp(-sum(case when not isnan(log_likelihood) then log_likelihood end) / sum(case when log_likelihood is not null and not isnan(log_likelihood) then terminal_count end)), 6) ppl, round(sum(model_candidate_forwards) / sum(candidate_slots), 9) forward_ratio from d group by 1")
def result_merge(spark, sf):
    """Results of documents merged by run: each document once, sums, perplexity, ratios."""
    ok = F.col("log_likelihood").isNotNull() & ~F.isnan("log_likelihood")
    return _results(spark, sf).groupBy("run_name").agg(
        F.count("*").alias("documents"), F.sum("sentence_count").alias("sentences"), F.sum("terminal_count").alias("terminals"), F.count_if(~ok).alias("without_score"),
        F.round(F.exp(-F.sum(F.when(ok, F.col("log_likelihood"))) / F.sum(F.when(ok, F.col("terminal_count")))), 6).alias("ppl"),
        F.round(F.sum("model_candidate_forwards") / F.sum("candidate_slots"), 9).alias("forward_ratio"),
    )


@query(f"with {_D} select d.run_name, count(distinct document_count) contracts, min(document_count)::int declared, count(*) merged, count(distinct document_id) distinct_ids, min(document_count) = count(*) and count(distinct document_count) = 1 complete, count_if(sentence_count < 0 or terminal_count < 0 or model_candidate_forwards > candidate_slots)::bigint broken from d group by 1")
def result_contract(spark, sf):
    """Whether the results of a run keep one contract: one declared number of documents, which is the number
    of distinct ones, no negative counts, and no more candidates scored than there are slots."""
    return _results(spark, sf).groupBy("run_name").agg(
        F.countDistinct("document_count").alias("contracts"), F.min("document_count").alias("declared"), F.count("*").alias("merged"), F.countDistinct("document_id").alias("distinct_ids"),
        ((F.min("document_count") == F.count("*")) & (F.countDistinct("document_count") == 1)).alias("complete"), F.count_if((F.col("sentence_count") < 0) | (F.col("terminal_count") < 0) | (F.col("model_candidate_forwards") > F.col("candidate_slots"))).alias("broken"),
    )


_SEQ = f"{_S}, q as (select run_name, task, doc_id, count(*) sentences, max(cont_id) + 1 expected, count(distinct cont_id) distinct_ids, min(cont_id) low, sum(full_score_raw) total, sum(term_score_raw + nt_score_raw) parts, count_if(full_score_raw is null or term_score_raw is null or nt_score_raw is null) missing from s group by 1, 2, 3)"


@query(f"with {_SEQ} select run_name, count(*) documents, sum(sentences)::bigint sentences, count_if(low <> 0 or expected <> distinct_ids)::bigint broken_sequence, count_if(missing > 0)::bigint without_score, count_if(missing = 0 and abs(total - parts) > 1e-6)::bigint sums_differ from q group by 1")
def sentence_cover(spark, sf):
    """Merge of parts of documents: ids must run from 0 without a gap, and a document's total must be the sum
    of its terminal and other parts. Sums are of decimals, so that a difference of just the tolerance is none
    whatever the order of the rows; of doubles only where a score isn't finite, or too large."""
    raw = ["full_score_raw", "term_score_raw", "nt_score_raw"]
    s = _scores(spark, sf).withColumns({f"_{c}": F.col(c).try_cast("decimal(32,12)") for c in raw})
    q = s.groupBy(*KEY).agg(
        F.count("*").alias("sentences"), (F.max("cont_id") + 1).alias("expected"), F.countDistinct("cont_id").alias("distinct_ids"), F.min("cont_id").alias("low"), F.sum("full_score_raw").alias("total"), F.sum(F.col("term_score_raw") + F.col("nt_score_raw")).alias("parts"),
        F.count_if(F.col("full_score_raw").isNull() | F.col("term_score_raw").isNull() | F.col("nt_score_raw").isNull()).alias("missing"),
        F.bool_or(F.col("_full_score_raw").isNull() | F.col("_term_score_raw").isNull() | F.col("_nt_score_raw").isNull()).alias("inexact"), F.sum(F.col("_full_score_raw") - F.col("_term_score_raw") - F.col("_nt_score_raw")).alias("left"),
    )
    differs = F.when(F.col("inexact"), F.abs(F.col("total") - F.col("parts")) > 1e-6).otherwise(F.abs("left") > F.lit("0.000001").cast("decimal(7,6)"))
    return q.groupBy("run_name").agg(
        F.count("*").alias("documents"), F.sum("sentences").alias("sentences"), F.count_if((F.col("low") != 0) | (F.col("expected") != F.col("distinct_ids"))).alias("broken_sequence"), F.count_if(F.col("missing") > 0).alias("without_score"),
        F.count_if((F.col("missing") == 0) & differs).alias("sums_differ"),
    )


@query("""
with u as (select distinct document_id from doc_results), r as (select distinct run_name from doc_results), n as (select run_name, document_id, count(*) n from doc_results group by 1, 2)
select r.run_name, count(*) expected, count(n) present, count(*) - count(n) missing, count_if(n > 1)::bigint delivered_again, count_if(d.doc_id is null)::bigint unknown from r cross join u left join n using (run_name, document_id) left join documents d on d.doc_id = u.document_id group by 1""")
def docppl_merge(spark, sf):
    """Cover of each run: documents that some run has, missing here, delivered more than once, unknown to the corpus."""
    n = table(spark, sf, "doc_results").groupBy("run_name", "document_id").agg(F.count("*").alias("n"))
    known = docs(spark, sf).select(F.col("doc_id").alias("document_id")).distinct().withColumn("known", F.lit(1))
    per_doc = n.select("document_id").distinct().join(known, "document_id", "left")
    expected, unknown = per_doc.agg(F.count("*"), F.count_if(F.col("known").isNull())).first()
    own = n.groupBy("run_name").agg(F.count("*").alias("present"), F.count_if(F.col("n") > 1).alias("delivered_again"))
    return own.select("run_name", F.lit(expected).cast("bigint").alias("expected"), "present", (F.lit(expected).cast("bigint") - F.col("present")).alias("missing"), "delivered_again", F.lit(unknown).cast("bigint").alias("unknown"))


@query("""
with r as (select source_shard, start_tok, end_tok, lag(end_tok) over (partition by source_shard order by start_tok, end_tok) before from records)
select source_shard, count(*) intervals, count_if(before is not null and start_tok > before)::bigint gaps, count_if(before is not null and start_tok < before)::bigint overlapping, min(start_tok) low, max(end_tok) high, count_if(before is not null and start_tok <> before)::bigint = 0 and min(start_tok) = 0 tiles from r group by 1""")
def interval_tiling(spark, sf):
    """Whether the intervals of a shard follow each other without gap or overlap."""
    r = ordered.with_previous(table(spark, sf, "records").select("source_shard", "start_tok", "end_tok"), ["start_tok", "end_tok"], "end_tok", "before", ["source_shard"])
    return r.groupBy("source_shard").agg(
        F.count("*").alias("intervals"), F.count_if(F.col("start_tok") > F.col("before")).alias("gaps"), F.count_if(F.col("start_tok") < F.col("before")).alias("overlapping"), F.min("start_tok").alias("low"), F.max("end_tok").alias("high"),
        ((F.count_if(F.col("start_tok") != F.col("before")) == 0) & (F.min("start_tok") == 0)).alias("tiles"),
    )


@query("select source_shard, ordinal // 300 batch, count(*) n, max(end_tok - start_tok) longest, sum(end_tok - start_tok)::bigint total from records group by 1, 2")
def batch_max(spark, sf):
    """Longest record of each batch of 300 in a shard."""
    n = F.col("end_tok") - F.col("start_tok")
    return table(spark, sf, "records").groupBy("source_shard", F.floor(F.col("ordinal") / 300).alias("batch")).agg(F.count("*").alias("n"), F.max(n).alias("longest"), F.sum(n).alias("total"))


@query(r"""select user_id, arg_max(regexp_extract(props, '"k": *(\d+)', 1), (ts, event_id)) last_k, count(*) lines from events where props like '%"k"%' group by 1""")
def log_last_value(spark, sf):
    """The last value of a key in each user's log lines."""
    e = table(spark, sf, "events").where(F.col("props").contains('"k"'))
    return e.groupBy("user_id").agg(F.max_by(F.regexp_extract("props", r'"k": *(\d+)', 1), F.struct("ts", "event_id")).alias("last_k"), F.count("*").alias("lines"))


@query(r"""with l as (select user_id, event_id, ts, props, row_number() over (partition by user_id order by ts desc, event_id desc) back from events) select user_id, count(*) lines, count_if(props like '%"k"%')::bigint keyed, max(case when back = 1 then props like '%"k"%' end) ends_with_mark from l group by 1""")
def log_exit_marker(spark, sf):
    """Whether each user's log ends with a line that has the mark."""
    mark = F.coalesce(F.col("props").contains('"k"'), F.lit(False))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if(mark).alias("keyed"), F.max_by(mark, F.struct("ts", "event_id")).alias("ends_with_mark"))


@query("select event_type, count(*) lines, round(quantile_cont(value, 0.5), 9) median, round(quantile_cont(value, 0.9), 9) p90, round(count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 9) per_second from events where value is not null group by 1")
def profile_medians(spark, sf):
    """Median and 90th percentile of the values of each kind of log line, and lines a second."""
    seconds = F.expr("timestampdiff(microsecond, min(ts), max(ts))") / 1e6
    return table(spark, sf, "events").where("value is not null").groupBy("event_type").agg(F.count("*").alias("lines"), F.round(F.percentile("value", 0.5), 9).alias("median"), F.round(F.percentile("value", 0.9), 9).alias("p90"), F.round(F.try_divide(F.count("*"), seconds), 9).alias("per_second"))


@query(f"""
with t as (select item_id, {Q.tokens('question')} q, {Q.tokens('passage')} p from eval_items where question is not null and passage is not null),
g as (select item_id, n, side, gram, count(*) c from (select item_id, 1 n, 'q' side, unnest(q) gram from t union all select item_id, 1, 'p', unnest(p) from t union all select item_id, 2, 'q', unnest(list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1])) from t union all select item_id, 2, 'p', unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) from t) group by 1, 2, 3, 4),
m as (select item_id, n, gram, coalesce(max(case when side = 'q' then c end), 0) a, coalesce(max(case when side = 'p' then c end), 0) b from g group by 1, 2, 3)
select item_id, n::int n, sum(least(a, b))::bigint shared, round(2.0 * sum(least(a, b)) / (sum(a) + sum(b)), 9) f1 from m group by 1, 2""")
def rouge12(spark, sf):
    """Overlap of words and of word pairs between question and passage, as F1 (without stemming)."""
    t = table(spark, sf, "eval_items").where("question is not null and passage is not null").select("item_id", tokens(F.col("question")).alias("q"), tokens(F.col("passage")).alias("p"))
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(s).alias("side"), grams(F.col(s), n).alias("grams")) for n in (1, 2) for s in ("q", "p")))).alias("x")
    g = t.select("item_id", sides).select("item_id", "x.n", "x.side", F.explode("x.grams").alias("gram"))
    m = g.groupBy("item_id", "n", "gram").agg(F.count_if(F.col("side") == "q").alias("a"), F.count_if(F.col("side") == "p").alias("b"))
    return m.groupBy("item_id", "n").agg(F.sum(F.least("a", "b")).alias("shared"), F.round(2.0 * F.sum(F.least("a", "b")) / (F.sum("a") + F.sum("b")), 9).alias("f1"))


@query(f"with {_S} select run_name, task, doc_id, cont_id, full_score_raw, min(cont_id) over (partition by run_name, task, doc_id, full_score_raw) first_at, count(*) over (partition by run_name, task, doc_id, full_score_raw) same from s where full_score_raw is not null")
def stable_unique(spark, sf):
    """Choices of equal score, with the first of them."""
    w = Window.partitionBy(*KEY, "full_score_raw")
    return _scores(spark, sf).where("full_score_raw is not null").select(*KEY, "cont_id", "full_score_raw", F.min("cont_id").over(w).alias("first_at"), F.count("*").over(w).alias("same"))


_SEQS = "sq as (select item_id, unnest(choices) c, unnest(range(len(choices))) k from eval_items where choices is not null)"


@query(f"with {_SEQS}, p as (select item_id, k, list_filter(regexp_extract_all(lower(c), '[a-z0-9]+'), lambda w: w not in ('a', 'an', 'the')) seq from sq), f as (select *, min(k) over (partition by item_id, seq) first_k from p) select item_id, k, first_k, dense_rank() over (partition by item_id order by first_k) - 1 inverse, first_k = k kept from f")
def projected_unique(spark, sf):
    """Choices of each item whose word sequences, without articles, are equal: the first is kept, and every
    choice has the place of its sequence among the kept ones."""
    c = table(spark, sf, "eval_items").where("choices is not null").select("item_id", F.posexplode("choices").alias("k", "c"))
    p = c.select("item_id", F.col("k").cast("bigint").alias("k"), F.filter(F.regexp_extract_all(F.lower("c"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin("a", "an", "the")).alias("seq"))
    f = p.withColumn("first_k", F.min("k").over(Window.partitionBy("item_id", "seq")))
    inverse = F.dense_rank().over(Window.partitionBy("item_id").orderBy("first_k")).cast("bigint") - 1
    return f.select("item_id", "k", "first_k", inverse.alias("inverse"), (F.col("first_k") == F.col("k")).alias("kept"))
