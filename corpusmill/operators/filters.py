"""Document filters: reasons, lines that repeat, published quality rules, periods in token arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import formulas
from corpusmill.functions import signals as S
from corpusmill.functions.text import SPACE, squeezed
from corpusmill.functions.words import runs, word_hashes


def reasons(text: Column, rules: dict[str, str] | None = None) -> Column:
    """Names of the rules that a text breaks, in their order; none for a null text."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in (rules or S.REASONS).items())))


def signal_rows(df: DataFrame, id: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(id, signal, occurrences) of each signal that a text shows; 10 or more bars are a pipe table, and
    three or more copies of a long line are a repeated one."""
    rules = (rules or S.SIGNALS) | {"ptb_quote": S.PTB_QUOTE}
    counted = [F.struct(F.lit(n).alias("signal"), F.regexp_count(text, F.lit(p)).alias("occurrences")) for n, p in rules.items()]
    bars = F.regexp_count(text, F.lit(r"\|"))
    counted.append(F.struct(F.lit("pipe_table_candidate").alias("signal"), F.when(bars >= 10, bars).otherwise(0).alias("occurrences")))
    shown = df.select(id, F.explode(F.filter(F.array(*counted), lambda s: s["occurrences"] > 0)).alias("s")).select(id, "s.*")
    lines = repeated_lines(df, id, text).groupBy(id).agg(F.sum(F.col("n") - 1).cast("int").alias("occurrences"))
    return shown.unionByName(lines.select(id, F.lit("repeated_long_line_candidate").alias("signal"), "occurrences"))


def signal_examples(df: DataFrame, id: str, text: str, each: int = 2) -> DataFrame:
    """(id, signal, occurrences, examples): the first matches of each signal of one expression."""
    found = [F.struct(F.lit(n).alias("signal"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m")) for n, p in (S.SIGNALS | {"ptb_quote": S.PTB_QUOTE}).items()]
    rows = df.select(id, F.explode(F.filter(F.array(*found), lambda s: F.size(s["m"]) > 0)).alias("s"))
    return rows.select(id, "s.signal", F.size("s.m").alias("occurrences"), F.slice("s.m", 1, each).alias("examples"))


def repeated_lines(df: DataFrame, id: str, text: str, copies: int = 3, words: int = 8) -> DataFrame:
    """line_counts() of lines that stand at least `copies` times and have `words` words."""
    gaps = F.length(squeezed(F.col("line"))) - F.length(F.replace(squeezed(F.col("line")), F.lit(" "), F.lit("")))
    return line_counts(df, id, text, False).where((F.col("n") >= copies) & (gaps >= words - 1))


def line_counts(df: DataFrame, id: str, text: str, squeeze: bool) -> DataFrame:
    """(id, chars, line, n): how often each line of 80 characters or more stands in its document."""
    lines = df.where(F.col(text).isNotNull()).select(id, F.length(text).alias("chars"), F.explode(F.split(text, "\n")).alias("line"))
    lines = lines.withColumn("line", squeezed(F.col("line")) if squeeze else F.regexp_replace("line", f"^[{SPACE}]+|[{SPACE}]+$", "")).where("length(line) >= 80")
    return lines.groupBy(id, "chars", "line").agg(F.count("*").alias("n"))


_FORMULA = "decision string, confirmed int, uncertain int, signals array<struct<kind:string,confirmed:boolean,start:int,stop:int,matched:string>>, truncated boolean"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("confirmed", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32()), ("matched", pa.string())]))


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(t, formulas.signals(t)) for t in batch.column(1).to_pylist()]
        sure = [sum(s.confirmed for s in own) for _, own in found]
        listed = [[{"kind": s.kind, "confirmed": s.confirmed, "start": s.start, "stop": s.end, "matched": t[s.start : s.end][:180]} for s in own[: formulas.LISTED]] for t, own in found]
        cols = [pa.array([formulas.decide(own) for _, own in found]), pa.array(sure, pa.int32()), pa.array([len(own) - k for (_, own), k in zip(found, sure)], pa.int32()), pa.array(listed, _FOUND), pa.array([len(own) > formulas.LISTED for _, own in found])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(c if len(c) else c.cast(k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), _FOUND, pa.bool_())))], ["id", "decision", "confirmed", "uncertain", "signals", "truncated"])


def formula_rows(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, decision, confirmed, uncertain, signals, truncated) of every row: whether formulas are certain
    (drop), likely (review) or none (keep), how many, and the first 20 with their places. Null texts are
    kept. Texts without any mark of a formula don't leave the JVM: they go as nulls."""
    kind = df.schema[id].dataType.simpleString()
    marked = F.when(F.col(text).rlike(r"[\\<$=∑∏∫√]"), F.col(text))
    return df.select(id, marked.alias("t")).mapInArrow(_classified, f"`{id}` {kind}, {_FORMULA}")


@F.pandas_udf(T.StringType())
def _decision(text: pd.Series) -> pd.Series:
    return text.map(lambda t: formulas.decide(formulas.signals(t)))


def formula_decision(text: Column) -> Column:
    """formula_rows()' decision as a column."""
    return _decision(F.when(text.rlike(r"[\\<$=∑∏∫√]"), text))


# Thresholds published for the Gopher, C4 and FineWeb rules, in the order of the chain.
TOP_GRAMS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_GRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
POLICIES = ["terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies"]
LINE_WORDS, WORD_LENGTH, SENTENCES = 3, 1000, 5
REPETITION = {
    "repetition_paragraphs": "duplicate_paragraphs > 0.3 * paragraphs",
    "repetition_paragraph_chars": "duplicate_paragraph_chars > 0.2 * chars",
    "repetition_lines": "duplicate_lines > 0.3 * all_lines",
    "repetition_line_chars": "duplicate_line_chars > 0.2 * chars",
    **{f"repetition_top_{n}": f"top_{n} > {t} * chars" for n, t in TOP_GRAMS.items()},
    **{f"repetition_duplicate_{n}": f"duplicate_{n} > {t} * chars" for n, t in DUPLICATE_GRAMS.items()},
}
QUALITY = {
    "gopher_words": "words < 50 or words > 100000",
    "gopher_word_length": "mean_word_length < 3 or mean_word_length > 10",
    "gopher_symbols": "symbols > 0.1 * words",
    "gopher_bullets": "bullet_lines > 0.9 * lines",
    "gopher_ellipsis": "ellipsis_lines > 0.3 * lines",
    "gopher_alpha": "alpha_words < 0.8 * words",
    "gopher_stop_words": "stop_words < 2",
}
C4 = {"c4_lorem": "lorem", "c4_curly": "curly", "c4_sentences": f"sentences < {SENTENCES}"}


def fineweb(prefix: str) -> dict[str, str]:
    return {
        f"{prefix}_punctuation": f"{prefix}_ended <= 0.12 * {prefix}_lines",
        f"{prefix}_short_lines": f"{prefix}_short >= 0.67 * {prefix}_lines",
        f"{prefix}_duplicates": f"{prefix}_duplicate_chars >= 0.1 * {prefix}_chars",
    }


#: The chain: FineWeb's rules are for the text that C4 has rewritten. STAGES run by themselves as well.
CHAIN = REPETITION | QUALITY | C4 | fineweb("after_c4")
STAGES = {"repetition": REPETITION, "quality": QUALITY, "c4": C4, "fineweb": fineweb("fineweb"), "fineweb_rstrip": fineweb("rstrip"), "fineweb_after_c4": fineweb("after_c4")}


def _gram_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, squeezed text) to (id, characters of the most frequent run, of runs that came before)."""
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            own = text.split(" ") if text else []
            hashes, ends = word_hashes(own), np.cumsum([0, *map(len, own)])
            row = []
            for n in TOP_GRAMS:
                grams, first, times = np.unique(runs(hashes, n), return_index=True, return_counts=True)
                best = times == times.max() if len(grams) else times
                sizes = ends[first[best] + n] - ends[first[best]] + n - 1 if len(grams) else np.zeros(1, int)
                row.append(int(sizes.max()) * int(times.max() if len(grams) else 0))
            for n in DUPLICATE_GRAMS:
                grams = runs(hashes, n)
                if len(grams):
                    _, first, back = np.unique(grams, return_index=True, return_inverse=True)
                    again = np.flatnonzero(first[back] < np.arange(len(grams)))
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, again, 1)
                    np.add.at(edge, again + n, -1)
                    row.append(int(np.diff(ends)[np.cumsum(edge[:-1]) > 0].sum()))
                else:
                    row.append(0)
            rows.append(row)
        flat = np.array(rows, np.int64).reshape(-1, len(TOP_GRAMS) + len(DUPLICATE_GRAMS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(flat[:, k]) for k in range(flat.shape[1]))], ["id", *(f"top_{n}" for n in TOP_GRAMS), *(f"duplicate_{n}" for n in DUPLICATE_GRAMS)])


def repetition_statistics(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, counts) for REPETITION, for documents with a text. Lines and paragraphs are what line ends, and
    empty lines, part; a duplicate is one that stood before. Runs are of words between white space: the
    characters of the most frequent run in all its places (the longest of several), and those of words in
    places of runs that stood before, each once."""
    kind = df.schema[id].dataType.simpleString()
    t = df.where(F.col(text).isNotNull()).select(id, F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "").alias("t"))
    grams = t.select(id, squeezed(F.col("t"))).mapInArrow(_gram_chars, f"`{id}` {kind}, " + ", ".join([f"top_{n} bigint" for n in TOP_GRAMS] + [f"duplicate_{n} bigint" for n in DUPLICATE_GRAMS]))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    p = t.select(id, F.length("t").alias("chars"), F.filter(F.split("t", r"\n{2,}"), lambda x: x != "").alias("ps"), F.filter(F.split("t", r"\n+"), lambda x: x != "").alias("ls"))
    own = p.select(
        id, "chars", F.size("ps").alias("paragraphs"), (F.size("ps") - F.size(F.array_distinct("ps"))).alias("duplicate_paragraphs"), (chars(F.col("ps")) - chars(F.array_distinct("ps"))).alias("duplicate_paragraph_chars"),
        F.size("ls").alias("all_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).alias("duplicate_lines"), (chars(F.col("ls")) - chars(F.array_distinct("ls"))).alias("duplicate_line_chars"),
    )
    return own.join(grams, id)


def c4_lines(lines: Column) -> tuple[Column, Column, Column]:
    """(kept lines, filler among them, a brace among them) under C4's rules for lines: marks of citations
    go; lines of few words or of one word without end go, and those on scripts and policies."""
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\[\d*\]|\[edit\]|\[citation needed\]", ""), f"^[{SPACE}]+|[{SPACE}]+$", "")))
    low = lambda x: F.lower(x)
    live = F.filter(clean, lambda x: (F.size(F.regexp_extract_all(x, F.lit(f"[^{SPACE}]+"), F.lit(0))) >= LINE_WORDS) & ~x.rlike(f"[^{SPACE}]{{{WORD_LENGTH + 1}}}"))
    shown = F.filter(live, lambda x: ~F.contains(low(x), F.lit("javascript")))
    kept = F.filter(shown, lambda x: ~low(x).rlike("|".join(POLICIES)))
    return kept, F.exists(live, lambda x: F.contains(low(x), F.lit("lorem ipsum"))), F.exists(shown, lambda x: F.contains(x, F.lit("{")))


_ENDED = r"""[.!?"'”’]\z"""


def _fineweb(prefix: str, lines: Column) -> list[Column]:
    """Counts of FineWeb's rules; lines that are blank don't count."""
    own = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    return [
        F.size(own).alias(f"{prefix}_lines"), F.size(F.filter(own, lambda x: x.rlike(_ENDED))).alias(f"{prefix}_ended"), F.size(F.filter(own, lambda x: F.length(x) <= 30)).alias(f"{prefix}_short"),
        (chars(own) - chars(F.array_distinct(own))).alias(f"{prefix}_duplicate_chars"), chars(own).alias(f"{prefix}_chars"),
    ]


def chain_statistics(df: DataFrame, id: str, text: str) -> DataFrame:
    """The counts that QUALITY, C4 and FineWeb's rules need, for documents with a text; all in the JVM.
    FineWeb's are of the lines as stored, of lines without white space at their ends, and of C4's lines."""
    d = df.where(F.col(text).isNotNull()).select(id, F.col(text).alias("t"))
    d = d.withColumn("ws", F.filter(F.split(squeezed(F.col("t")), " "), lambda w: w != "")).withColumn("raw", F.split("t", "\n")).withColumn("ls", F.filter(F.transform("raw", squeezed), lambda x: x != ""))
    d = d.withColumn("stripped", F.transform("raw", lambda x: F.regexp_replace(x, f"[{SPACE}]+$", "")))
    kept, lorem, curly = c4_lines(F.col("raw"))
    d = d.withColumn("kept", kept)
    own = F.array_distinct(F.transform("ws", F.lower))
    count = lambda c, f: F.size(F.filter(c, f))
    ends = F.aggregate("kept", F.lit(0), lambda a, x: a + F.greatest(F.lit(1), F.regexp_count(x, F.lit(r"[.!?…]+[\"'”’)]*(?:\s|$)"))))
    return d.select(
        id,
        F.size("ws").alias("words"), F.size("ls").alias("lines"),
        (F.length(F.array_join("ws", "")) / F.greatest(F.size("ws"), F.lit(1))).alias("mean_word_length"),
        (F.regexp_count("t", F.lit("#")) + F.regexp_count("t", F.lit(r"\.\.\.|…"))).alias("symbols"),
        count("ls", lambda x: x.rlike(r"^[•‣▪◦*–-]")).alias("bullet_lines"), count("ls", lambda x: x.rlike(r"(?:\.\.\.|…)$")).alias("ellipsis_lines"),
        count("ws", lambda w: w.rlike(r"\p{L}")).alias("alpha_words"), F.size(F.array_intersect(own, F.array(*map(F.lit, STOP_WORDS)))).alias("stop_words"),
        lorem.alias("lorem"), curly.alias("curly"), ends.alias("sentences"), F.size("kept").alias("kept_lines"),
        *_fineweb("fineweb", F.col("raw")), *_fineweb("rstrip", F.col("stripped")), *_fineweb("after_c4", F.col("kept")),
    )


def failures(rules: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(n)) for n, rule in rules.items())))


def chain(stats: DataFrame, id: str) -> DataFrame:
    """(id, failed, first_failure): every rule of the chain that fails, and the first; FineWeb's rules
    only count where C4's have passed. stats: the columns of both statistics."""
    passed = F.size(failures(C4)) == 0
    failed = F.concat(failures(REPETITION | QUALITY | C4), F.when(passed, failures(fineweb("after_c4"))).otherwise(F.array().cast("array<string>")))
    return stats.select(id, failed.alias("failed")).withColumn("first_failure", F.get("failed", F.lit(0)))


def independent(stats: DataFrame, id: str) -> DataFrame:
    """(id, stage, reason): the first rule that fails of each stage by itself; FineWeb on C4's text where C4 passes."""
    passed = F.size(failures(C4)) == 0
    first = {n: F.when(passed, F.get(failures(r), F.lit(0))) if n == "fineweb_after_c4" else F.get(failures(r), F.lit(0)) for n, r in STAGES.items()}
    return stats.select(id, F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), c.alias("reason")) for n, c in first.items()))).alias("s")).select(id, "s.*").where("reason is not null")


def periodic_rejected(found: DataFrame, id: str, most: int = 32) -> DataFrame:
    """(id, times) of arrays to be left out, of periodic()'s rows: those with a stretch of `most` times or more."""
    return found.groupBy(id).agg(F.max("times").alias("times")).where(F.col("times") >= most)


def periodic(df: DataFrame, id: str, items: str, periods: int = 13, least: int = 3) -> DataFrame:
    """(id, period, times) of each stretch that repeats with a period of at most `periods` (and of a
    third of the array) `least` times or more. A maximal run of places equal to the one a period
    before, of length r, is r + period long. Runs are islands of places: equal to place minus rank."""
    rows = df.where(F.size(items) >= 3).select(id, F.col(items).alias("x"), F.explode(F.sequence(F.lit(1), F.least(F.lit(periods), F.floor(F.size(items) / 3).cast("int")))).alias("period"))
    # whether each place equals the one a period before, as a string of 0 and 1, whose runs of 1 are the stretches
    same = F.array_join(F.transform(F.sequence(F.col("period") + 1, F.size("x")), lambda i: F.when(F.element_at("x", i) == F.element_at("x", i - F.col("period")), "1").otherwise("0")), "")
    runs = rows.select(id, "period", F.explode(F.regexp_extract_all(same, F.lit("1+"), F.lit(0))).alias("run"))
    times = F.floor((F.length("run") + F.col("period")) / F.col("period"))
    return runs.select(id, "period", times.cast("bigint").alias("times")).where(F.col("times") >= least)
