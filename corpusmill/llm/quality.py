"""Text statistics of documents, and text types learnt from them without labels.

Method: each statistic's thresholds are a noisy labelling function that votes prose, not prose or
nothing. How often each function is right, and how frequent the types are, is learnt by
expectation-maximization from how the functions agree over all documents; a document's type is
the posterior given its votes. The maximization runs on the histogram of vote patterns, which has
at most 3 ** len(RULES) rows however many documents there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

#: Frequent function words of some European languages.
COMMON = frozenset(
    """
    the a an of and to in is was were that it for on with as at by from this these those be been are or not but their its our your his her
    every each another before after who which when while because although until unless since so if during behind beside across through without
    under near above into than then there they them you we he she i may might must should could would can will did do does has have had most
    many some no nobody both how what where why all also
    der die das den dem des ein eine einen einem einer und ist nicht mit von zu für auf aus bei nach weil aber oder im am wird hat sich wir es
    sie er ich dass wie auch noch nur über
    le la les l un une du de et est que qui dans pour pas avec sur par mais ne on en ou au aux ce cette sans il elle plus se sont
    el los las una del y es por con para su lo al pero sin como más muy entre o ningún
    het een van en niet met voor op zijn dat te door maar ook bij aan
    lo gli di e non che della nel sono ma uno dei si
    os um uma do da dos das não em mas ao
    och att det som på är av för inte den til og ikke som med jag
    i w na z się nie do to że jest и в на не с что это по как но
    """.split()
)
#: Words of the printers' filler text and its usual variants.
FILLER = frozenset(
    """
    lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
    voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit
    anim id est laborum curabitur pellentesque vestibulum mauris vivamus phasellus praesent aliquam tincidunt vehicula sagittis pulvinar lacinia
    ultricies ultrices rutrum ornare porta semper viverra felis risus tellus turpis luctus lacus mattis gravida justo neque augue mollis
    fermentum bibendum malesuada volutpat interdum egestas hendrerit dapibus sollicitudin suspendisse
    """.split()
)
_EDGE = "\"'“”‘’«»()[]{}.,;:!?…*_`"
_MARK = re.compile(r"^\s*(?:[-–—•*·▪‣>+]\s|\d+[.)]\s|[#|]|def |return\b|if .*:$|\w[\w ]{0,24}:\s|.*(?:\.{4,}|\||\t|»|;\s*$|\w\(\w*\):?))")
_ODD = re.compile(r"[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]{2}|[^\W_][|;/+=<>$%#@&^~\\][^\W_]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-–—‘’“”«»…¿¡]|_")
STATS = ["words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "running", "digit_tokens", "marked_lines", "short_lines", "filler_words", "odd_tokens", "longest_plain"]
#: statistic, not prose when, prose when. Between the two a function is silent.
RULES: list[tuple[str, str, str]] = [
    ("common_words", "common_words < 0.10", "common_words >= 0.18"),
    ("running", "running < 0.45", "running >= 0.60"),
    ("mean_word_length", "mean_word_length > 9 or mean_word_length < 2.5", "mean_word_length between 4 and 7"),
    ("symbol_ratio", "symbol_ratio > 0.06", "symbol_ratio < 0.02"),
    ("punctuated_lines", "punctuated_lines < 0.15", "punctuated_lines >= 0.6"),
    ("digit_tokens", "digit_tokens > 0.25", "digit_tokens < 0.08"),
    ("marked_lines", "marked_lines > 0.5", "marked_lines < 0.2"),
    ("short_lines", "short_lines > 0.5", "short_lines < 0.15"),
    ("filler_words", "filler_words > 0.4", "filler_words < 0.2 and common_words >= 0.10"),
    ("odd_tokens", "odd_tokens > 0.2", "odd_tokens < 0.03"),
    ("longest_plain", "longest_plain > 0.5", "longest_plain < 0.2"),
]


def statistics(text: str | None) -> tuple[float, ...]:
    """STATS of one text; all are 0 where there is no token. Shares of lines are weighted by tokens.
    running: share of tokens in stretches (a line, or 30 tokens of a long one) that read like sentences.
    longest_plain: the longest stretch of tokens without a common word, as a share of all."""
    tokens = text.split() if text else []
    n = len(tokens)
    if not n:
        return (0.0,) * len(STATS)
    common = filler = digits = odd = length = running = marked = short = ended = plain = longest = 0
    for line in text.splitlines():
        own = line.split()
        if not own:
            continue
        if len(own) <= 5:
            short += len(own)
        if _MARK.match(line):
            marked += len(own)
        if own[-1].rstrip("\"'”’»)]*_` ")[-1:] in tuple(".!?…:。！？"):
            ended += len(own)
        for k in range(0, len(own), 30):
            part = own[k : k + 30]
            hits = words = 0
            for t in part:
                w = t.strip(_EDGE).lower()
                length += len(w)
                if w in COMMON:
                    hits += 1
                    plain = 0
                else:
                    plain += 1
                    if plain > longest:
                        longest = plain
                if w in FILLER:
                    filler += 1
                if w.isalpha():
                    words += 1
                elif any(c.isdigit() for c in t) or w in ("", "-"):
                    digits += 1
                if len(t) > 3 and _ODD.search(t):
                    odd += 1
            common += hits
            if hits >= 0.15 * len(part) and words >= 0.6 * len(part) and len(part) > 2:
                running += len(part)
    return (n, length / n, len(_SYMBOL.findall(text)) / len(text), ended / n, common / n, running / n, digits / n, marked / n, short / n, filler / n, odd / n, longest / n)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[:, 0].astype(np.int64)), *(pa.array(rows[:, k]) for k in range(1, len(STATS)))], ["id", *STATS])


def text_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, STATS...) of every row. Null, empty and blank texts have zeros. Extra columns are
    ignored, null ids and repeated rows kept. No shuffle."""
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(_measured, f"`{id}` {kind}, words bigint, " + ", ".join(f"{s} double" for s in STATS[1:]))


def votes() -> list[Column]:
    """1 for not prose, 0 for prose, 2 for silence, by RULES."""
    return [F.expr(f"case when {bad} then 1 when {good} then 0 else 2 end") for _, bad, good in RULES]


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of not prose, and the probability of each vote by function, type and vote, by
    expectation-maximization; begun at the majority of the votes, which also says which type is which."""
    m, k = patterns.shape
    bad, good = (patterns == 1).sum(1), (patterns == 0).sum(1)
    post = np.where(bad > good, 0.9, 0.1)
    prior, chance = 0.5, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts], 1)
        prior = float((weight[:, 1].sum() + 1) / (counts.sum() + 2))
        for j in range(k):
            for v in range(3):
                chance[j, :, v] = weight[patterns[:, j] == v].sum(0) + 1
            chance[j] /= chance[j].sum(1, keepdims=True)
        score = np.log(prior / (1 - prior)) + sum(np.log(chance[j, 1, patterns[:, j]] / chance[j, 0, patterns[:, j]]) for j in range(k))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, chance


def text_types(docs: DataFrame, id: str = "doc_id", text: str = "text", min_tokens: int = 30) -> DataFrame:
    """(id, STATS..., not_prose, text_type) of every row. not_prose is the posterior probability;
    text_type is `prose` or `not_prose`, and `short` for rows of fewer than min_tokens tokens (null,
    empty and blank texts too), which are neither learnt from nor judged. An empty table gives none."""
    stats = materialize(text_statistics(docs, id, text).select("*", F.array(*votes()).alias("votes")), "stats")
    seen = stats.where(F.col("words") >= min_tokens).groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    if not seen:
        return stats.select("*", F.lit(None).cast("double").alias("not_prose"), F.lit("short").alias("text_type")).drop("votes")
    prior, chance = learn(np.array([r[0] for r in seen]), np.array([r[1] for r in seen], float))
    weights = np.log(chance[:, 1] / chance[:, 0])
    score = F.lit(float(np.log(prior / (1 - prior))))
    for j, vote in enumerate(weights):
        v = F.col("votes")[j]
        score = score + F.when(v == 0, float(vote[0])).when(v == 1, float(vote[1])).otherwise(float(vote[2]))
    judged = F.when(F.col("words") >= min_tokens, 1 / (1 + F.exp(-score)))
    return stats.select("*", judged.alias("not_prose")).drop("votes").withColumn("text_type", F.expr("case when not_prose is null then 'short' when not_prose > 0.5 then 'not_prose' else 'prose' end"))
