from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.words import words
from corpusmill.llm import leaks, packing, quality, residue, residue_seeds

# ---- leaks


def brute_leaks(docs, items, length):
    out = set()
    for item, passage, question in items:
        for text in (passage, question):
            w = words(text)
            wanted = {tuple(w[k : k + length]) for k in range(len(w) - length + 1)}
            for doc, t in docs:
                d = words(t)
                if item is not None and doc is not None and any(tuple(d[k : k + length]) in wanted for k in range(len(d) - length + 1)):
                    out.add((item, doc))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 26])
def test_leaks(spark, bits):
    rng = random.Random(4)
    w = [f"w{rng.randrange(40)}" for _ in range(400)]
    items = [(k, " ".join(w[k * 30 : k * 30 + 25]), " ".join(w[k * 7 : k * 7 + 13])) for k in range(10)] + [(20, None, "too short"), (21, "", None), (None, " ".join(w[:30]), None), (3, " ".join(w[90:115]), None)]
    docs = [(i, "Start " + ", ".join(w[k : k + n]).upper() + " end") for i, (k, n) in enumerate([(0, 12), (0, 13), (5, 40), (100, 14), (31, 13), (300, 100), (33, 12)])]
    docs += [(90, None), (91, ""), (92, " ".join(w[:13])), (92, " ".join(w[:13])), (None, " ".join(w)), (93, " ".join(reversed(w)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("gram", F.lit("clash")).withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, passage string, question string").withColumn("window", F.lit("clash"))
    got = leaks.leaks(d, i, bits=bits)
    assert got.columns == ["item_id", "doc_id"] and sorted(map(tuple, got.collect())) == brute_leaks(docs, items, 13)
    assert leaks.leaks(d.limit(0), i).collect() == [] and leaks.leaks(d, i.limit(0)).collect() == []


# ---- packing


def check_packing(rows, sizes, caps):
    seen, fill = {}, {}
    for r in rows:
        fill[r.pack_id, r.container] = fill.get((r.pack_id, r.container), 0) + r.tokens
        seen.setdefault((r.pack_id, r.doc_id), []).append((r.piece, r.start, r.tokens))
    assert all(n <= caps[p] for (p, _), n in fill.items())
    for p, cap in caps.items():
        for doc, n in sizes.items():
            pieces = sorted(seen.pop((p, doc), []))
            assert sum(t for _, _, t in pieces) == max(n or 0, 0)
            assert [k for k, _, _ in pieces] == list(range(len(pieces))) and (len(pieces) <= 1 or n > cap)
            assert [s for _, s, _ in pieces] == [sum(t for _, _, t in pieces[:k]) for k in range(len(pieces))]
    assert not seen
    return fill


def test_pack(spark):
    rng = random.Random(8)
    sizes = {i: rng.choice([0, None, 1, 5, 64, 70, 100, 129, rng.randrange(1, 300)]) for i in range(400)}
    caps = {1: 64, 2: 130}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long").withColumn("capacity", F.lit(1)).withColumn("salt", F.lit("clash"))
    limits = spark.createDataFrame([(1, 64, "a"), (2, 130, "b"), (3, None, "c"), (4, 0, "d")], "pack_id int, capacity int, purpose string")
    fill = check_packing(packing.pack(df, limits).collect(), sizes, caps)
    for p, cap in caps.items():
        used = sum(n or 0 for n in sizes.values())
        bins = len({c for q, c in fill if q == p})
        assert bins <= 1.15 * used / cap + 2
    assert packing.pack(df.limit(0), limits).collect() == [] and packing.pack(df, limits.limit(0)).collect() == []


def test_hot_length(spark):
    df = spark.range(900).selectExpr("id doc_id", "if(id < 600, 33L, id % 60 + 1) tokens")
    limits = spark.createDataFrame([(1, 100)], "pack_id int, capacity int")
    sizes = {r.doc_id: r.tokens for r in df.collect()}
    fill = check_packing(packing.pack(df.repartition(3), limits).collect(), sizes, {1: 100})
    assert len(fill) <= 1.02 * -(-sum(sizes.values()) // 100) + 2


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.integers(1, 200, 5000), return_counts=True)
    rows, n, bound = packing.plan(lengths, counts, 256, 500)
    assert bound - 1e-6 <= n <= 1.02 * (lengths @ counts) / 256 + 2
    placed = {s: 0 for s in lengths.tolist()}
    assert set(rows) == set(placed) and all((np.diff(r[:, 0]) > 0).all() for r in rows.values())


@pytest.mark.parametrize("capacity", [64, 256, 1024])
def test_program_places_nearly_all(capacity):
    """Configurations hold at least nine tenths of the volume; the plan is close to the bound and not worse than best fit."""
    rng = np.random.default_rng(6)
    lengths, counts = np.unique(np.minimum(np.ceil(rng.lognormal(4.5, 0.8, 20_000)), 4000).astype(int) % capacity, return_counts=True)
    lengths, counts = lengths[1:], counts[1:]
    left = counts.copy()
    groups = packing._configured(lengths, left, capacity, packing.ROUNDS)
    assert sum(n * int(used @ lengths) for used, n in groups) >= 0.9 * (lengths @ counts)
    rows, n, bound = packing.plan(lengths, counts, capacity)
    plain = packing._best_fit(lengths, counts, capacity, [])
    assert -(-(lengths @ counts) // capacity) - 1e-6 <= bound + 1 and bound - 1e-6 <= n <= min(sum(k for _, k in plain), 1.02 * bound + 2)


def test_lower_bound_holds():
    assert packing.lower_bound(np.array([51, 60]), np.array([7, 5]), 100) == 12
    assert packing.lower_bound(np.array([34]), np.array([10]), 100) == 5
    assert packing.lower_bound(np.array([50]), np.array([10]), 100) == 5


def test_best_configuration_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 12, 4))
        prices = rng.random(len(lengths))
        used, price = packing.best_configuration(lengths, prices, 20)
        best = 0.0
        for combo in np.ndindex(*(20 // x + 1 for x in lengths)):
            if np.dot(combo, lengths) <= 20:
                best = max(best, float(np.dot(combo, prices)))
        assert used @ lengths <= 20 and abs(used @ prices - price) < 1e-9 and abs(price - best) < 1e-9


# ---- quality

PROSE = "The old bridge was rebuilt in the spring, and the town was glad of it. Nobody could say who had paid for the stones, but they were there. When the river rose again, the bridge stood. "
GERMAN = "Der alte Wald ist nicht weit von der Stadt, und die Kinder gehen am Abend oft mit dem Hund an den Fluss. Es ist nicht klar, wer das Haus am Ufer gebaut hat. "


def test_text_types(spark):
    rng = random.Random(6)
    rows = [(i, PROSE * 2 + f"It was {i} years ago.") for i in range(40)] + [(100 + i, GERMAN * 2) for i in range(8)] + [(150, (PROSE * 2).lower()), (151, (PROSE * 2).replace(". ", " . ").replace(",", " ,"))]
    junk = ["\n".join(f"item{k}\t{rng.randrange(999)}\t{rng.random():.2f}\t-" for k in range(30)), "\n".join(f"{w}: {w}, {w}x" for w in "abcdefghij" * 4), " ".join(rng.choice(["copper", "river", "stone", "lamp"]) for _ in range(80)), "## $$ %% ^^ && ** !! " * 12, "lorem ipsum dolor sit amet velit nulla quis. " * 12]
    rows += [(200 + i, junk[i % len(junk)] + f" {i}") for i in range(15)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "short one"), (304, "x" * 200_000), (None, PROSE * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = {r.doc_id: r.text_type for r in quality.text_types(df).collect()}
    assert {k for k, v in got.items() if v == "not_prose"} == set(range(200, 215))
    assert {got[k] for k in (300, 301, 302, 303, 304)} == {"short"} and got[None] == got[150] == got[151] == "prose"
    assert quality.text_types(df.limit(0)).collect() == [] and len(got) == len(rows)


def test_learnt_accuracies_follow_agreement():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    right = [0.95, 0.9, 0.85, 0.6]
    v = np.stack([np.where(rng.random(4000) < r, truth, ~truth) for r in right], 1).astype(int)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    prior, chance = quality.learn(patterns, counts.astype(float))
    assert abs(prior - 0.2) < 0.05
    for j, r in enumerate(right):
        assert abs(chance[j, 1, 1] - r) < 0.08 and abs(chance[j, 0, 0] - r) < 0.08


# ---- residue


@pytest.fixture(scope="module")
def tables():
    return residue.fit([PROSE, GERMAN, "Home\nAbout\nContact\nLog in", "name | 12 | 4.5\nother | 9 | 7", "The price is $5 and 10 % of {x : x > 0}."] * 20)


@pytest.mark.parametrize(
    "text",
    ["404 Not Found", "Error 500 - Internal error\nPlease try again later.", "Please enable JavaScript in your browser to continue.", "This site does not work without scripts.", "Dear {{ first_name }},\nthe old bridge was rebuilt.", PROSE + "The mayor of [insert city here] was glad of it.", PROSE + "\nLorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.\n" + PROSE, "Seite nicht gefunden. Die Seite existiert leider nicht.", "Welcome to <%= title %>!", "HTTP\xa0403\xa0(Forbidden)"],
)
def test_residue_is_found(tables, text):
    assert residue.spans(residue.normal(text), *tables)


@pytest.mark.parametrize("text", ["", "x", PROSE, GERMAN, "Home\nAbout\nContact\nLog in", 'The phrase "page not found" became a joke in the town after the library lost the manuscript.', "In the tutorial, `{{ name }}` marks a slot that the engine fills.", "Writing ${PATH} in a shell example prints the search path.", "The set {{1}, {2}} is used in the proof.", "values[[index]] is nested, and the price was $5 to $9."])
def test_content_is_kept(tables, text):
    assert residue.spans(residue.normal(text), *tables) == []


def test_residue_table(spark):
    rows = [(1, "404 Not Found"), (2, PROSE), (3, None), (4, ""), (5, " "), (6, PROSE * 3000), (7, "404 Not Found"), (7, "404 Not Found"), (None, "Please enable JavaScript in your browser.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit("clash"))
    labels = spark.createDataFrame([(2, 5, 0), (2, None, 0), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = residue.residue(df, labels).collect()
    assert sorted((r.doc_id or 0, r.chars > 0) for r in got) == [(0, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, True), (7, True)]
    assert all(0 <= r.coverage <= 1 for r in got) and residue.residue(df.limit(0), labels.limit(0)).collect() == []


def test_models_are_distributions():
    m = residue.Model(residue_seeds.notices()[:200])
    assert np.allclose(m.p.reshape(-1, residue.SIZE).sum(1), 1, atol=1e-3)


def test_residue_learns_from_every_text(spark):
    """Models come from all texts in full: not from labelled ones, nor from some lines of each."""
    rng = random.Random(8)
    makers = ["".join(rng.choice("bdfgklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(40)]
    long = "\n".join(f"{rng.choice(makers)} server error {rng.choice(makers)} {rng.choice(makers)}" for _ in range(400))
    rows = [(k, f"Fatal error in {makers[k]} was a song by {makers[-k]}.\n" + (long if k == 3 else PROSE)) for k in range(40)] + [(98, "404 Not Found"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = [t for _, t in rows if t]
    tables = residue.fit(texts)
    for got in (residue.fit_table(df), residue.fit(texts[::-1])):
        assert all((a == b).all() for a, b in zip(tables, got))
    labels = spark.createDataFrame([(3, 5, 0)], "doc_id long, quality int, toxic int")
    want = sorted((k, residue._size(residue.spans(residue.normal(t or ""), *tables))) for k, t in rows)
    assert sorted((r.doc_id, r.chars) for r in residue.residue(df, labels).collect()) == want and dict(want)[98] == 13 and dict(want)[3] == 0
    counts = residue.tally(texts, None)
    content = sum(len(x) + 3 for t in texts[:40] for x in t.split("\n") if x.strip())  # each with line ends
    assert counts[1][counts[0] < residue.GRAMS].sum() >= content


def test_texts_are_scored_together_as_alone(tables):
    rng = random.Random(9)
    parts = ["404 Not Found", "Please enable JavaScript.", "{{ name }}", "${user_id}", '"page not found"', "@@x_y@@", "&lt;your name&gt;", "lorem ipsum dolor sit amet", PROSE, GERMAN, "\n", "\n\n", " ", ". ", "! ", "a", "é", "\ud800", "\x00", "[insert city here]", "Something went wrong. Please try again later."]
    texts = [residue.normal("".join(rng.choice(parts) for _ in range(rng.randrange(7)))) for _ in range(1500)]
    got = [x for part in residue.chunks(texts) for x in residue.located(part, *tables)]
    assert got == [residue.spans(t, *tables) for t in texts] and sum(map(bool, got)) > 300


def test_line_is_scored_without_its_neighbours(tables):
    line = "Please enable JavaScript in your browser to continue."
    n = len(line)
    alone = residue.grams([line])[1][:n]
    for before in ("a\n", "the prime of\n", "x.\n\n"):
        assert (residue.grams([before + line])[1][len(before) :][:n] == alone).all()


def test_models_do_not_hang_on_the_size_of_the_corpus(monkeypatch):
    texts = [PROSE, GERMAN, "404 Not Found", "Lesson 4 - Frost\nServer\nFunction again.", PROSE + "{{ name }}"]
    monkeypatch.setattr(residue, "WEIGHT", 500)
    for a, b in zip(residue.fit(texts), residue.fit(texts * 30)):
        assert np.abs(a.astype(int) - b).max() <= 1


def test_content_of_unlabelled_documents_is_learnt(spark):
    """Lines that look like a notice until the texts that have them are counted, none of them labelled."""
    lists = PROSE + "\n" + "\n".join(f"Access road {k}\nAvailable from {k}" for k in range(60))
    df = spark.createDataFrame([(0, PROSE), (99, "404 Not Found")] + [(k, lists) for k in range(1, 21)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 5, 0)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in residue.residue(df, labels).where("chars > 0").collect()] == [99]
