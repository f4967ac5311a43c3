"""Operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing names."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.words import runs, word_hashes, words
from corpusmill.operators import dedup, filters, metrics, ordered, similarity, splits, streams, trees
from corpusmill.operators.graph import connected_components
from corpusmill.operators.intervals import interval_join, steps_in
from corpusmill.operators.packing import greedy_chunks
from corpusmill.operators.splitting import cut_long, split_sentences, split_words
from corpusmill.plans import matching, texts
from corpusmill.plans import metrics as metric_plans
from corpusmill.plans import splits as split_plans
from corpusmill.sources import files
from corpusmill.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words():
    assert words(None) == words("") == words(" \n") == []
    assert words("A-LRB-b_c É é½") == ["a", "b", "c", "é", "é½"]
    assert words("-lrb-x") == ["lrb", "x"]
    assert len(runs(word_hashes(["a"] * 4), 5)) == 0 and len(runs(word_hashes(list("abcdef")), 5)) == 2


@pytest.mark.parametrize("shape", ["chain", "star", "random", "twins"])
def test_components(spark, shape):
    rng = random.Random(shape)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 60)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], "twins": [(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (7, 6)]}[shape]
    parent = {n: n for e in edges for n in e if n is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a is not None and b is not None and a != b for n in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got) == sorted(((n, find(n)) for n in linked), key=str)


def test_components_of_nothing(spark):
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, parts):
    rng = random.Random(3)
    data = [(rng.choice("ab") if rng.random() < 0.9 else None, i, rng.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(parts)
    want, total = [], {}
    for g, i, v in data:
        total[g] = total.get(g, 0) + (v or 0)
        want.append((g, i, v, total[g]))
    assert rows(ordered.running(df, ["i"], {"t": F.col("v")}, ["g"])) == sorted(want, key=str)
    assert rows(ordered.numbered(df, ["i"]).select("i", "rn")) == sorted(((i, i + 1) for _, i, _ in data), key=str)
    assert rows(ordered.numbered(df.limit(0), ["i"])) == []


def test_first_and_marked(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "b"), ("k", 1, "a"), (None, 9, "n"), (None, 8, "m")], "key string, ord int, x string")
    assert rows(dedup.first_of(df, ["key"], "ord", "x")) == [("k", 1, "a"), (None, 8, "m")]
    assert rows(dedup.marked(df, ["key"], "ord").select("ord", "duplicate_of", "copies")) == [(1, None, 3), (1, None, 3), (3, 1, 3)]


def _sets(texts):
    return {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts if (w := t.split()) and len(w) >= 5}


@pytest.mark.parametrize("parts", [1, 5])
def test_near_against_all_pairs(spark, parts):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for i in range(24):
        own = list(base if i % 2 else [f"v{k % 9}" for k in range(60)])
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
        texts.append((i, " ".join(own)))
    texts += [(50, "a b c d e"), (51, "a b c d e"), (52, ""), (53, "one two"), (54, " ".join(base[:60]))]
    sets, size = _sets(texts), {i: len(t.split()) for i, t in texts}
    want = []
    for a, b in itertools.combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        j, m = c / len(sets[a] | sets[b]), c / min(len(sets[a]), len(sets[b]))
        if j >= 0.8 or (m >= 0.8 and min(size[a], size[b]) >= 50 and c >= 20):
            want.append((a, b))
    df = spark.createDataFrame(texts, "id long, text string").repartition(parts).select("id", X.tokens(F.col("text")).alias("words"))
    g = similarity.gram_sets(df, "id", "words", 5)
    assert rows(similarity.near(similarity.overlap_pairs(g, g, 0.8, self_join=True)).select("a", "b")) == sorted(want, key=str)
    left, right = g.where("id % 2 = 0"), g.where("id % 2 = 1")
    cross = sorted(((a, b) if a % 2 == 0 else (b, a) for a, b in want if a % 2 != b % 2), key=str)
    assert rows(similarity.near(similarity.overlap_pairs(left, right, 0.8)).select("a", "b")) == cross


def test_coverage_is_a_union(spark):
    w = [f"w{k}" for k in range(100)]
    left = spark.createDataFrame([(1, w), (2, ["z"]), (3, [])], "id int, words array<string>")
    right = spark.createDataFrame([(1, w[:20]), (2, w[40:60]), (3, w[:15]), (4, w[:5])], "id int, words array<string>")
    assert rows(similarity.coverage(left, right, 13)) == [(1, 40, 100), (2, 0, 1), (3, 0, 0)]
    assert rows(similarity.coverage(left, right.limit(0), 13)) == [(1, 0, 100), (2, 0, 1), (3, 0, 0)]


def test_decisions(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (5, 5)], "node int, component int")
    reasons = spark.createDataFrame([(2, "near"), (2, "near"), (9, "x")], "node int, reason string")
    assert rows(dedup.decisions(members, reasons)) == [(1, 1, ["near"], False), (2, 1, ["near", "content_group_nonrepresentative"], False), (5, 5, [], True)]
    big = spark.createDataFrame([(i, 0) for i in range(3)], "node int, component int")
    assert rows(dedup.decisions(big, reasons.limit(0), limit=2).where("node = 0")) == [(0, 0, ["large_content_group_requires_review"], False)]


def test_allocation_ties(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert [r.k for r in splits.allocated(s, "k", "n", 1).where("share = 1").collect()] == ["a"]
    assert [r.k for r in splits.allocated(s, "k", "n", 1, last_key_first=True).where("share = 1").collect()] == ["c"]
    assert sum(r.share for r in splits.allocated(s, "k", "n", 7).collect()) == 7


def test_budget_overshoots_by_one(spark):
    df = spark.createDataFrame([(i, 4, 0) for i in range(9)] + [(99, None, 0), (100, 4, 7)], "i int, n int, s int")
    assert [r[0] for r in rows(splits.budgeted(df, ["i"], "n", "s", {0: 10}).select("i"))] == [0, 1, 2]


def test_hash_split_is_the_digest_prefix(spark):
    import hashlib

    data = [(hashlib.sha256(str(i).encode()).hexdigest(),) for i in range(300)]
    got = {r[0]: r[1] for r in spark.createDataFrame(data, "h string").select("h", splits.hash_split(F.col("h"), 16)).collect()}
    for (h,) in data:
        k = int(h[:16], 16) % 16
        assert got[h] == {0: 1, 1: 2}.get(k, 0)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_greedy_chunks(spark, block):
    rng = random.Random(block)
    sizes = [rng.choice([0, 1, 3, 7, 12, None]) for _ in range(40)]
    total, chunk, want = 0, 1, []
    for i, n in enumerate(sizes):
        n = min(n or 0, 10)
        total, chunk = (n, chunk + 1) if total + n > 10 else (total + n, chunk)
        want.append((i, chunk))
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int")
    assert rows(greedy_chunks(df, "i", "n", 10, rows=block)) == sorted(want, key=str)


def test_interval_join(spark):
    points = spark.createDataFrame([("s", p) for p in (0, 5, 9, 10, 99)] + [(None, 1), ("s", None)], "g string, p long")
    spans = spark.createDataFrame([("s", 0, 5), ("s", 5, 10), ("s", 7, 7), ("t", 0, 99)], "g string, a long, b long")
    assert rows(interval_join(points, spans, ["g"], "p", "a", "b", 4).select("p", "a")) == [(0, 0), (5, 5), (9, 5)]


def test_trees(spark):
    p = spark.createDataFrame(
        [(1, "(S (NP (DT the) (NN cat)) (VP (VBD sat) (-LRB- -LRB-)))"), (1, "(S (NP (DT the) (NN cat)) (VP (VBD sat) (-LRB- -LRB-)))"), (2, "(S (NP"), (3, None), (4, ""), (5, "(X (Y a)) (X (Y b))"), (6, ")(")], "parse_id int, parsed string"
    )
    t = {r[0]: r[1] for r in trees.linearized(p).collect()}
    assert t == {1: ["<(S>", "<(NP>", "the", "cat", "<NP)>", "<(VP>", "sat", "(", "<VP)>", "<S)>"], 5: ["<(X>", "a", "<X)>", "<(X>", "b", "<X)>"]}
    tree = spark.createDataFrame([(t[1],)], "t array<string>")
    one = lambda c: tree.select(c).first()[0]
    assert one(trees.terminal(F.col("t"))) == ["the", "cat", "sat", "("]
    assert one(trees.compressed(F.col("t"))) == ["<(S>", "<(NP>", "the", "cat", "<)>", "<(VP>", "sat", "(", "<)>"]
    assert one(F.size(trees.closes_times(F.col("t"), 2))) == 13 and one(F.size(trees.closes_times(F.col("t"), 3))) == 16
    assert rows(trees.spans(p).select("parse_id", "label", "l", "r")) == sorted([(1, "S", 0, 3), (1, "NP", 0, 1), (1, "VP", 2, 3), (5, "X", 0, 0), (5, "X", 1, 1)], key=str)
    assert {r.parse_id: r.balanced for r in trees.balance(trees.events(p)).collect()} == {1: True, 2: False, 5: True, 6: False}
    assert one(trees.framed(trees.framed(F.col("t")))) == ["<s>", *t[1], "</s>"]
    assert spark.createDataFrame([(["a", "<s>", "b"],)], "t array<string>").select(trees.framed(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("n,p,q", [(0, 1, 2), (5, 2, 2), (6, 1, 3), (3, 0, 1)])
def test_pauses(spark, n, p, q):
    got = spark.createDataFrame([([str(k) for k in range(n)],)], "t array<string>").select(trees.pauses(F.col("t"), p, q)).first()[0]
    want = [x for k in range(n) for x in [str(k)] + ["<pause>"] * (p if (k + 1) % q == 0 else 0)]
    assert got == want and len(got) == n + n // q * p


def test_streams(spark):
    d = spark.createDataFrame([("s", 1, [5, 6]), ("s", 2, []), ("t", 1, [7])], "g string, o int, ids array<int>")
    at = streams.offsets(d, "g", ["o"], F.size("ids") + 2)
    flat = streams.stream(at, "g", "start", "ids").select("g", (F.col("start") + F.col("i")).alias("pos"), "tok")
    assert rows(streams.segments(flat, "g", "pos", "tok")) == [("s", 0, 4, True), ("s", 4, 6, True), ("t", 0, 3, True)]
    broken = flat.where(f"not (g = 't' and tok = {streams.EOS})")
    assert rows(streams.segments(broken, "g", "pos", "tok").where("not valid").select("g")) == [("t",)]
    lens = lambda x: spark.createDataFrame([(x,)], "a array<int>").select(streams.document_lengths(F.col("a"), 9)).first()[0]
    assert lens([1, 2, 9, 3]) == [3, 1] and lens([1, 9]) == [2] and lens([9, 9]) == [1, 1] and lens([1]) == [1] and lens([]) == []
    assert spark.createDataFrame([(list(range(7)),)], "a array<int>").select(streams.chunks(F.col("a"), 3)).first()[0] == [[0, 1, 2], [3, 4, 5]]


def test_patches_replay(spark):
    text = "a -LRB-b-RRB- c-LSB-"
    got = streams.patches(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text", X.BRACKETS).orderBy("at").collect()
    out, shift = text, 0
    for r in got:
        at = r["at"] + shift
        assert out[at : at + len(r.old)] == r.old
        out = out[:at] + r.new + out[at + len(r.old) :]
        shift = r["shift"]
    assert out == "a (b) c[" and len(text) + shift == len(out)


def test_periodic_against_brute_force(spark):
    rng = random.Random(5)
    data = [(i, [rng.randrange(2) for _ in range(rng.randrange(0, 24))]) for i in range(60)]
    want = []
    for i, x in data:
        for p in range(1, min(5, len(x) // 3) + 1):
            run = 0
            for k in range(p, len(x) + 1):
                if k < len(x) and x[k] == x[k - p]:
                    run += 1
                else:
                    if run and (run + p) // p >= 3:
                        want.append((i, p, (run + p) // p))
                    run = 0
    df = spark.createDataFrame(data, "id int, x array<int>")
    assert rows(filters.periodic(df, "id", "x", 5)) == sorted(want, key=str)


def test_signal_expressions(spark):
    cases = {
        "uncorrected machine - read text": {"uncorrected_machine_read_notice"}, "``so'' it goes ''": {"ptb_quote"}, "end . Then ; x": {"space_before_punctuation"}, "a .5 b": set(), "<(NP> x <NP)>": {"literal_tree_marker"},
        "he do n't": {"split_contraction"}, "it â€™s": {"mojibake_candidate"}, "&nbsp;": {"html_entity_candidate"}, "<p class=x>": {"html_tag_candidate"}, "{{cite| title=": {"wiki_citation_markup_candidate"},
        "def add (": {"code_syntax_candidate"}, "public static void": {"code_syntax_candidate"}, "f(x) = sin(x)": {"function_equation_candidate"}, "f(x) = 3": set(), "-LRB- a": {"ptb_bracket"}, "|" * 10: {"pipe_table_candidate"}, "|" * 9: set(),
        "Leave a  reply": {"web_ui_phrase_candidate"}, "\n".join(["a long line of eight words or more that is repeated here, as adverts on old pages often are"] * 3): {"repeated_long_line_candidate"}, "x" * 90 + "\n" + "x" * 90 + "\n" + "x" * 90: set(), "": set(),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)] + [(99, None)], "id int, t string")
    got = {}
    for r in filters.signal_rows(df, "id", "t").collect():
        got.setdefault(r.id, set()).add(r.signal)
    assert {t: got.get(k, set()) for k, t in enumerate(cases)} == cases and 99 not in got
    assert {r.signal for r in filters.signal_examples(df, "id", "t").collect()} <= {s for v in got.values() for s in v}


def test_function_equations_need_one_equals_sign(spark):
    df = spark.createDataFrame([("f(x) == 3",), ("f(x) = 3",), ("u(x ) = ln(x )",)], "t string")
    assert [r[0] for r in df.select(filters.reasons(F.col("t"))).collect()] == [[], ["function_equation"], ["function_equation"]]


def test_formula_rows(spark):
    df = spark.createDataFrame([(1, "x^2 = 4 and " * 30), (2, None), (3, "plain"), (None, "$a=b$")], "id int, t string").withColumn("decision", F.lit("clash"))
    got = {r.id: r for r in filters.formula_rows(df, "id", "t").collect()}
    assert got[1].decision == "drop" and got[1].truncated and len(got[1].signals) == 20 and got[1].confirmed == 30 and got[2].decision == got[3].decision == "keep" and got[None].confirmed == 1
    assert filters.formula_rows(df.limit(0), "id", "t").collect() == []


def test_repetition_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "b", "cccc", "dd"]) for _ in range(n)) for n in (0, 1, 4, 9, 30, 80)] + ["one line\n\none line\n\nother", None, "  "]
    got = {r.id: r for r in filters.repetition_statistics(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        w = t.split()
        for n in (2, 3, 4):
            grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]
            most = max((grams.count(g) for g in grams), default=0)
            assert got[i][f"top_{n}"] == max((most * len(g) for g in grams if grams.count(g) == most), default=0)
        for n in (5, 10):
            grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            again = {p for k, g in enumerate(grams) if g in grams[:k] for p in range(k, k + n)}
            assert got[i][f"duplicate_{n}"] == sum(len(w[p]) for p in again)
    assert (got[6].duplicate_paragraphs, got[6].duplicate_paragraph_chars, got[6].paragraphs) == (1, 8, 3)


def test_chain_stages(spark):
    good = "\n".join([
        "The first houses of that old town were built with stone from a quarry across the river.", "Nobody can say who paid for them, but it seems to have been the guild of weavers.",
        "Their marks still show above many doors, and children learn at school what each one means.", "In dry years people walk to the ford and look for coins between the pebbles.",
        "Most finds are worthless, though a silver buckle went to the museum last spring.", "It will be shown together with letters from merchants, maps and a broken loom.",
    ])
    texts = {"good": good, "lorem": good + "\nLorem ipsum dolor.", "curly": good + "\nand then { here", "script": good + "\nplease use JavaScript { here", "spaces": (good + "\n").replace(".\n", ". \n"), "repeat": (good.split("\n")[0] + "\n") * 9}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    stats = filters.repetition_statistics(df, "id", "t").join(filters.chain_statistics(df, "id", "t"), "id")
    first = {r.id: r.first_failure for r in filters.chain(stats, "id").collect()}
    assert first.pop("repeat").startswith("repetition_") and first == {"good": None, "lorem": "c4_lorem", "curly": "c4_curly", "script": None, "spaces": None}
    alone = {(r.id, r.stage) for r in filters.independent(stats, "id").collect()}
    assert ("lorem", "c4") in alone and ("lorem", "fineweb_after_c4") not in alone and ("repeat", "repetition") in alone and not [x for x in alone if x[0] == "good"]
    assert [s for i, s in alone if i == "spaces"] == ["fineweb"]  # lines as stored end in a space, not in a mark


def test_periodic_rejected(spark):
    df = spark.createDataFrame([(1, [1, 2] * 40), (2, [1, 2] * 10), (3, list(range(50)))], "id int, x array<int>")
    assert rows(filters.periodic_rejected(filters.periodic(df, "id", "x"), "id")) == [(1, 40)]


def test_quality_reasons(spark):
    cases = {
        "We write about cookies and cream.": [], "Please accept all cookies to go on.": ["web_boilerplate"], "f(x) = 3 holds": ["function_equation"], "cafÃ© Ã©": ["mojibake"], "<div>text": ["raw_html"],
        "Uncorrected OCR text": ["extraction_warning"], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", filters.reasons(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == {**cases, None: []}


@pytest.mark.parametrize("text,want", [("Let $x^2 = 4$ be", "drop"), ("\\frac{a}{b}", "drop"), ("a + b = 3 in the equation", "drop"), ("a + b = 3 apples", "drop"), ("function f(x) { const b = a + 2; }", "review"), (None, "keep"), ("It costs $5 and $7.", "keep"), ("see https://x.org/?a+b=3 here", "keep"), ("plain prose", "keep")])
def test_formula_decision(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(filters.formula_decision(F.col("t"))).first()[0] == want


def test_choices(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.0), (2, 2, 5.0), (3, 0, None), (3, 1, 2.0), (4, 0, float("nan")), (5, 0, -1.0)], "d int, c int, s double")
    assert rows(metrics.chosen(s, ["d"], "c", "s")) == [(1, 0), (5, 0)]
    twice = spark.createDataFrame([(1, "b", None), (1, "a", 5), (1, "c", 5)], "k int, x string, t int")
    assert rows(metrics.first_delivery(twice, ["k"], "t", "x")) == [(1, "a", 5)]


def test_bootstrap_holds_the_value(spark):
    b = spark.createDataFrame([("r", t, float(i % 4 == 0), 1.0) for t in ("x", "y") for i in range(400)], "run string, task string, num double, den double")
    got = {(r.task, r.metric): r for r in metrics.bootstrap(b, ["run", "task"], ["num", "den"], {"rate": lambda s: s["num"] / s["den"], "sum": lambda s: s["num"]}, samples=2000, macro="task").collect()}
    for task in ("x", "y", "_"):
        r = got[task, "rate"]
        assert r.value == 0.25 and r.low < 0.25 < r.high and 0.05 < r.high - r.low < 0.12
    assert got["_", "rate"].high - got["_", "rate"].low < got["x", "rate"].high - got["x", "rate"].low and got["x", "sum"].value == 100
    again = metrics.bootstrap(b.repartition(7), ["run", "task"], ["num", "den"], {"rate": lambda s: s["num"] / s["den"]}, samples=2000).where("task = 'x'").first()
    assert (again.low, again.high) == (got["x", "rate"].low, got["x", "rate"].high)
    assert metrics.bootstrap(b.limit(0), ["run", "task"], ["num", "den"], {"rate": lambda s: s["num"] / s["den"]}, samples=5).collect() == []


@pytest.mark.parametrize("limit", [1, 4, 7])
def test_cuts_lose_nothing(spark, limit):
    words_ = "One two, three four five. Six seven eight nine ten eleven".split()
    got = cut_long(words_, limit)
    assert sum(got, []) == words_ and all(len(p) <= limit for p in got)
    df = spark.createDataFrame([(1, " ".join(words_)), (2, None), (3, " \n")], "id int, text string")
    for f in (split_sentences, split_words):
        p = f(df, "id", "text", limit).orderBy("piece").collect()
        assert " ".join(r.text for r in p).split() == words_ and {r.id for r in p} == {1}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "aé \"q\""), (2, None)], "id int, t string")
    files.write_json(df, f"{tmp_path}/j")
    assert rows(files.read_json(spark, f"{tmp_path}/j", "id int, t string")) == rows(df)
    one = spark.createDataFrame([("x", "say \"hi\"")], "a string, b string")
    files.write_tsv(one.coalesce(1), f"{tmp_path}/t")
    assert rows(files.read_tsv(spark, f"{tmp_path}/t", "a string, b string")) == rows(one)
    assert files.schema_errors(df, "id bigint, t string, u string") == ["id: int, not bigint", "u: missing"]
    assert {r.lost + r.added for r in files.roundtrip(df.withColumn("s", F.lit(1)), "s").collect()} == {0}
    assert files.file_digests(spark, f"{tmp_path}/t/*.csv").count() >= 1
    assert files.read_lines(spark, f"{tmp_path}/t").count() == 2


def test_stream_resumes_and_keeps_first(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"file://{tmp_path}/out"
    schema = "id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "A b"), (4, None)], schema).coalesce(1).write.parquet(src)
    targets = {0: 1 << 40, 1: 1 << 40, 2: 1 << 40}
    first = incremental.run(spark, src, schema, "id", "text", targets, out).select("id")
    assert rows(first) == [(1,), (2,), (3,)]
    spark.createDataFrame([(0, "a"), (9, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    assert rows(incremental.run(spark, src, schema, "id", "text", targets, out).select("id")) == [(1,), (2,), (3,), (9,)]


def test_body_profile(spark):
    df = spark.createDataFrame([("Don't  -LRB-STOP-RRB-\nΣΑΣ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.body(F.col("t"))).collect()] == ["don ' t ( stop ) σασ", None, ""]
    assert df.select(X.content_key(F.col("t"))).collect()[1][0] is None


def test_previous_parts_and_chunks(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 2), ("a", 7), (None, 9)], "g string, x int")
    assert rows(ordered.with_previous(df, ["x"], "x", "p", ["g"])) == sorted([("a", 1, None), ("a", 3, 1), ("a", 7, 3), (None, 2, None), (None, 9, 2)], key=str)
    n = spark.range(1, 12).select("id", splits.parts(F.col("id"), 11, 4).alias("p"))
    assert [r.p for r in n.orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    b = spark.createDataFrame([("s", 0, 5), ("s", 5, 5), ("s", 5, 23), ("t", 0, 3)], "g string, a long, b long")
    assert rows(streams.chunk_lengths(b, "g", "a", "b", 10)) == [("s", 0, [5, 5]), ("s", 1, [10]), ("s", 2, [3]), ("t", 0, [3])]


def test_typed_balance_finds_crossed_labels(spark):
    data = [(1, ["<(A>", "x", "<(B>", "y", "<B)>", "<A)>"]), (2, ["<(A>", "<(B>", "x", "<A)>", "<B)>"]), (3, ["<(A>", "x"]), (4, ["x"]), (5, []), (6, None), (7, ["<A)>", "<(A>"]), (None, ["x"]), (8, ["<(A>", "x", "<A)>", "<(A>", "y", "<A)>"])]
    got = {r.parse_id: (r.roots, r.valid) for r in trees.typed_balance(spark.createDataFrame(data, "parse_id int, tree array<string>")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (0, True), 5: (0, True), 7: (0, False), 8: (2, True)}


def test_bucket_pairs_without_the_smallest(spark):
    """2 and 3 are alike and the bucket's smallest, 1, is like neither."""
    base = [f"w{k}" for k in range(40)]
    w = spark.createDataFrame([(1, [f"v{k}" for k in range(40)]), (2, base), (3, [*base[:39], "x"]), (4, base)], "id long, words array<string>")
    bands = spark.createDataFrame([(1, 0, 7), (2, 0, 7), (3, 0, 7), (2, 1, 8), (3, 1, 8), (4, 2, 9)], "id long, band int, key long")
    assert rows(similarity.bucket_pairs(bands, "id")) == [(1, 2), (1, 3), (2, 3)]
    assert rows(matching.similar_in_buckets(w, bands, 0.7).select("a", "b")) == [(2, 3)]


def test_minhash_clusters_take_unverified_links(spark, tmp_path, monkeypatch):
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(k, f"s{k}", "a b c d e f") for k in (1, 2, 3)], "doc_id long, source string, text string").write.parquet(str(path))
    bands = spark.createDataFrame([(1, 0, 7), (2, 0, 7), (3, 0, 7)], "id long, band int, key long")
    monkeypatch.setattr(matching.S, "minhash_bands", lambda *a, **k: bands)
    monkeypatch.setattr(matching.S, "jaccard", lambda: F.lit(0.0))
    assert rows(matching.minhash_clusters(spark, str(tmp_path))) == [(1, 3)]


def test_bands_are_independent_and_find_similar_documents(spark):
    rng = random.Random(5)
    docs = []
    for k in range(40):  # similarity above 0.95, with every run at another place
        own = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        docs += [(2 * k, own), (2 * k + 1, [*own[3:], *(f"x{rng.randrange(10**6)}" for _ in range(3))])]
    bands = similarity.minhash_bands(spark.createDataFrame(docs, "id long, words array<string>"), "id", "words")
    assert bands.select("id", "key").distinct().count() == 80 * 14
    assert rows(similarity.bucket_pairs(bands, "id")) == sorted([(2 * k, 2 * k + 1) for k in range(40)], key=str)


def test_content_edges_have_exact_and_partial(spark, tmp_path):
    own = [[f"w{d}x{k}" for k in range(60)] for d in range(4)]
    share = [f"s{k}" for k in range(30)]
    texts = [(1, "a b"), (2, "a b"), (3, " ".join(own[0] + share)), (4, " ".join(share + own[1])), (5, " ".join(own[2] + share[:20])), (6, " ".join(share[:30]))]
    spark.createDataFrame([(i, "s", 0, t) for i, t in texts], "doc_id long, source string, source_row long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(matching.content_edges(spark, str(tmp_path)).select("a", "b", "reason"))
    assert got == [(1, 2, "exact"), (3, 4, "partial")]  # 5 shares a quarter of itself, 6 is under 50 words
    assert (4, 3) in rows(matching.content_groups(spark, str(tmp_path)))


def test_pair_verify_reads_the_middle_of_a_group(spark, tmp_path):
    rows_in = [(1, "k", "a b"), (2, "k", "c d"), (3, "k", "a b"), (4, "m", "a"), (5, None, "a"), (6, "k", None)]
    spark.createDataFrame(rows_in, "record_id long, token_sha string, text string").write.parquet(str(tmp_path / "records.parquet"))
    assert rows(texts.pair_verify(spark, str(tmp_path))) == [(1, 2, 0.0), (1, 3, 1.0)]


def test_interval_lookup_reaches_each_shards_end(spark, tmp_path):
    given = [("a", 0, 0, 700), ("a", 1, 700, 1001), ("b", 0, 0, 400)]
    spark.createDataFrame(given, "source_shard string, ordinal int, start_tok long, end_tok long").write.parquet(str(tmp_path / "records.parquet"))
    assert rows(split_plans.interval_lookup(spark, str(tmp_path))) == [("a", 0, 0), ("a", 1000, 700), ("a", 500, 0), ("b", 0, 0)]


def test_anchor_lookup_of_large_ordinals(spark, tmp_path):
    given = [("a", 0, 0, 20, 1), ("a", 30_000_000, 2_910_000_000, 2_910_000_020, 2)]
    spark.createDataFrame(given, "source_shard string, ordinal int, start_tok long, end_tok long, record_id long").write.parquet(str(tmp_path / "records.parquet"))
    assert rows(split_plans.anchor_lookup(spark, str(tmp_path))) == [("a", 0, 13, 1), ("a", 30_000_000, 2_910_000_013, 2)]


def test_steps_in_intervals_of_any_place_and_length(spark):
    given = [(0, 700), (700, 1001), (-600, 1), (499, 500), (7, 7), (9, 3), (500, 501), (None, 900), (3, None)]
    want = [(a, b, p) for a, b in given if None not in (a, b) for p in range(0, 2000, 500) if a <= p < b]
    df = spark.createDataFrame(given, "a long, b long")
    assert rows(steps_in(df.where("a is not null"), "a", "b", 500, "p", 2)) == sorted(want, key=str)
    assert steps_in(spark.createDataFrame([(0, 1_000_001)], "a long, b long"), "a", "b", 1, "p", 1000).distinct().count() == 1_000_001


def test_interval_lookup_makes_no_grid(spark, tmp_path):
    far = 10**13
    spark.createDataFrame([("a", far, far + 600), (None, 0, 900)], "source_shard string, start_tok long, end_tok long").write.parquet(str(tmp_path / "records.parquet"))
    assert rows(split_plans.interval_lookup(spark, str(tmp_path))) == [("a", far, far), ("a", far + 500, far)]


def test_sentence_cover_takes_the_tolerance_as_written(spark, tmp_path):
    scores = {1: (-3.000001, -1.0, -2.0), 2: (-100.0000011, -60.0, -40.0), 3: (float("nan"), 0.0, 0.0), 4: (-3.0, None, -3.0), 5: (float("-inf"), -1.0, -1.0), 6: (-3.0, -1.0, -2.0)}
    assert abs(-3.000001 - (-1.0 - 2.0)) > 1e-6  # in doubles
    given = [("r", "t", d, 0, *x, None) for d, x in scores.items()]
    spark.createDataFrame(given, "run_name string, task string, doc_id long, cont_id int, full_score_raw double, term_score_raw double, nt_score_raw double, scored_at timestamp").write.parquet(str(tmp_path / "choice_scores.parquet"))
    got = metric_plans.sentence_cover(spark, str(tmp_path)).select("documents", "without_score", "sums_differ")
    assert rows(got) == [(6, 1, 3)]  # 2, 3 and 5


def edited(seed):
    """Documents of two sides with copies, passages, a template, repeats, and texts too short for runs."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    base, tail = [[word() for _ in range(90)] for _ in range(4)], [f"t{k}" for k in range(25)]
    docs = []
    for k in range(40):
        w = list(base[k % 4])
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = word()
        docs.append([w, w[10 : 10 + k], w + tail, [word() for _ in range(60)] + tail + tail, w[:30] * 2, ["a"] * (k % 9)][rng.randrange(6)])
    return [(k, w) for k, w in enumerate(docs)]


@pytest.mark.parametrize("self_join", [True, False])
def test_shared_runs_give_what_all_runs_give(spark, self_join):
    docs = spark.createDataFrame(edited(3), "id long, words array<string>").withColumn("side", F.lit(0) if self_join else (F.col("id") % 2).cast("int"))
    left, right = (docs, docs) if self_join else (docs.where("side = 0"), docs.where("side = 1"))
    runs = similarity.shared_runs(docs.select("id", F.array_join("words", " ").alias("body"), "side", (F.col("id") % 3).cast("int").alias("block")), (5, 13), (13,), self_join)
    five, sets = runs.where("n = 5"), [similarity.gram_sets(d, "id", "words", 5) for d in (left, right)]
    if self_join:
        want = similarity.overlap_pairs(*sets, 0.8, True, 50)
        assert rows(similarity.near(similarity.overlapping(five, 0.8, 50))) == rows(similarity.near(want)) != []
    else:
        assert rows(similarity.shared_pairs(five).select("a", "b", "ma", "mb", "na", "nb", "shared")) == rows(similarity.shared_counts(*sets).select("a", "b", "ma", "mb", "na", "nb", "shared")) != []
    placed = similarity.placed(runs.where("n = 13"))
    sizes = [runs.where("n = 13").select(F.col("id").alias(k), F.col("words_n").alias(f"n{k}")) for k in "ab"]
    assert rows(similarity.covered_pairs(placed, *sizes, 13, self_join, 0.3)) == rows(similarity.pair_coverage(left, right, 13, self_join, least=0.3)) != []
    if not self_join:
        assert rows(similarity.covered(placed, 13)) == rows(similarity.coverage(left, right, 13).where("covered > 0").select("id", "covered"))


def test_shared_runs_leave_out_what_one_document_has(spark):
    docs = spark.createDataFrame([(1, "a b c d e f a b c d e"), (2, "x b c d e f y"), (3, "p q r s t")], "id long, body string").withColumns({"side": F.lit(0), "block": F.col("id").cast("int")})
    runs = similarity.shared_runs(docs, (5,), (5,), True)
    assert rows(runs.select("id", "words_n", "m", F.col("at").cast("string"))) == [(1, 11, 6, "[2]"), (2, 7, 3, "[2]")]
