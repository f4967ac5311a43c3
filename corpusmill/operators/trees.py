"""Bracketed forests as marker arrays, and what is derived from them. A tree array holds opening
markers `<(L>`, leaves, and typed closing markers `<L)>`; preterminals have no markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import brackets

TOKEN = r"\([^\s()]*|\)|[^\s()]+"


def events(parses: DataFrame, id: str = "parse_id", parsed: str = "parsed") -> DataFrame:
    """(id, i, tok, step, depth, next_leaf, prev_leaf) of every token of every forest, in place i from
    0; step is 1 for opening, -1 for closing, 0 for a leaf; depth counts the brackets open after it.
    Rows of the same id are one forest (the smallest text); null and blank ones have no tokens."""
    one = parses.where(F.col(parsed).isNotNull()).groupBy(id).agg(F.min(parsed).alias("parsed"))
    t = one.select(id, F.posexplode(F.regexp_extract_all("parsed", F.lit(TOKEN), F.lit(0))).alias("i", "tok"))
    t = t.withColumn("step", F.when(F.col("tok").startswith("("), 1).when(F.col("tok") == ")", -1).otherwise(0))
    w = Window.partitionBy(id).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({"depth": F.sum("step").over(upto), "next_leaf": F.coalesce(F.lead("step").over(w) == 0, F.lit(False)), "prev_leaf": F.coalesce(F.lag("step").over(w) == 0, F.lit(False))})


def balance(ev: DataFrame, id: str = "parse_id") -> DataFrame:
    """(id, tokens, opens, closes, roots, balanced)."""
    last = F.max_by("depth", "i")
    return ev.groupBy(id).agg(
        F.count("*").alias("tokens"), F.count_if(F.col("step") == 1).alias("opens"), F.count_if(F.col("step") == -1).alias("closes"),
        F.count_if((F.col("step") == 1) & (F.col("depth") == 1)).alias("roots"), ((F.min("depth") >= 0) & (last == 0)).alias("balanced"),
    )


def typed(ev: DataFrame, id: str = "parse_id") -> DataFrame:
    """Rows of balanced forests with `level` (that of the bracket itself) and `label`, also of closing
    brackets: at one level openings and closings alternate, so a closing one has the label of the
    last opening one before it there."""
    good = balance(ev, id).where("balanced").select(id)
    rows = ev.join(good, id, "left_semi").withColumn("level", F.when(F.col("step") == -1, F.col("depth") + 1).otherwise(F.col("depth")))
    w = Window.partitionBy(id, "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("step") == 1, F.struct("i", F.expr("substring(tok, 2)").alias("label"), "next_leaf"))
    return rows.withColumn("opened", F.last(opened, ignorenulls=True).over(w)).withColumns({"label": F.col("opened.label"), "open_at": F.col("opened.i")})


def linearized(parses: DataFrame, id: str = "parse_id", parsed: str = "parsed") -> DataFrame:
    """(id, tree): the marker array of each balanced forest; leaves with bracket escapes read."""
    rows = typed(events(parses, id, parsed), id)
    mark = (
        F.when(F.col("step") == 0, brackets(F.col("tok")))
        .when((F.col("step") == 1) & ~F.col("next_leaf"), F.concat(F.lit("<("), "label", F.lit(">")))
        .when((F.col("step") == -1) & ~F.col("prev_leaf"), F.concat(F.lit("<"), "label", F.lit(")>")))
    )
    items = rows.withColumn("mark", mark).where("mark is not null")
    return items.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mark"))), lambda x: x["mark"]).alias("tree"))


def is_open(t: Column) -> Column:
    return t.startswith("<(") & t.endswith(">")


def is_close(t: Column) -> Column:
    return t.startswith("<") & t.endswith(")>")


def is_leaf(t: Column) -> Column:
    return ~is_open(t) & ~is_close(t)


def terminal(tree: Column) -> Column:
    return F.filter(tree, is_leaf)


def closes_times(tree: Column, n: int) -> Column:
    """Each closing marker n times (2: the tg form)."""
    return F.flatten(F.transform(tree, lambda t: F.array_repeat(t, F.when(is_close(t), n).otherwise(1))))


def without_opens(tree: Column) -> Column:
    return F.filter(tree, lambda t: ~is_open(t))


def compressed(tree: Column, mark: str = "<)>") -> Column:
    """Each run of closing markers as one generic mark."""
    kept = F.filter(tree, lambda t, i: ~is_close(t) | (i == 0) | ~is_close(F.get(tree, i - 1)))
    return F.transform(kept, lambda t: F.when(is_close(t), F.lit(mark)).otherwise(t))


def pauses(items: Column, p: int, q: int, mark: str = "<pause>") -> Column:
    """p marks after every complete block of q items; a rest gets none."""
    if p < 0 or q <= 0:
        raise ValueError("p >= 0 and q > 0")
    return F.flatten(F.transform(items, lambda t, i: F.concat(F.array(t), F.when((i + 1) % q == 0, F.array_repeat(F.lit(mark), p)).otherwise(F.array().cast("array<string>")))))


def pause_mask(items: Column, p: int, q: int) -> Column:
    """Which items of a paused array are pauses: the last p of every q + p."""
    return F.transform(items, lambda t, i: i % (q + p) >= q)


def unpaused(items: Column, p: int, q: int) -> Column:
    """The array before pauses()."""
    return F.filter(items, lambda t, i: i % (q + p) < q)


def without_last_pauses(items: Column, mark: str = "<pause>") -> Column:
    """Pauses at the end cut off."""
    last = F.array_max(F.transform(items, lambda t, i: F.when(t != mark, i + 1).otherwise(0)))
    return F.slice(items, 1, F.coalesce(last, F.lit(0)))


def frame_error(items: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """What is wrong with an array's markers: one of them inside, twice at an end, or nothing (null)."""
    n = F.size(items)
    inner = F.filter(items, lambda t, i: ((t == bos) & (i > 0)) | ((t == eos) & (i < n - 1)))
    return F.when(F.size(inner) > 0, F.concat(F.lit("misplaced "), F.get(inner, F.lit(0))))


def framed(items: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """bos first and eos last, once each; null where either stands elsewhere."""
    core = F.filter(items, lambda t, i: ~(((i == 0) & (t == bos)) | ((i == F.size(items) - 1) & (t == eos))))
    return F.when(F.exists(core, lambda t: (t == bos) | (t == eos)), F.lit(None)).otherwise(F.concat(F.array(F.lit(bos)), core, F.array(F.lit(eos))))


def spans(parses: DataFrame, id: str = "parse_id", parsed: str = "parsed") -> DataFrame:
    """(id, label, l, s, r): the leaves that each phrase covers, l to r with both, from 0; s is where its
    first part ends, a phrase or a leaf (r for a phrase of one part). One pass: the rows of a phrase are
    those of its own level between its brackets, and they are grouped by where it opens."""
    rows = typed(events(parses, id, parsed), id)
    w = Window.partitionBy(id).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("leaves", F.sum(F.when(F.col("step") == 0, 1).otherwise(0)).over(w))
    own = rows.where("step <> 0")
    own = own.withColumn("pre", F.when(F.col("step") == 1, F.col("next_leaf")).otherwise(F.col("prev_leaf")))
    opened = own.groupBy(id, "open_at").agg(F.min(F.when(F.col("step") == 1, F.col("leaves"))).alias("l"), F.max(F.when(F.col("step") == -1, F.col("leaves") - 1)).alias("r"), F.max("level").alias("level"), F.min("label").alias("label"), F.max("pre").alias("pre"))
    # the first part of a phrase is the first span of the next level that begins at its left end
    firsts = opened.where("r >= l").select(id, (F.col("level") - 1).alias("level"), "l", "r").groupBy(id, "level", "l").agg(F.max("r").alias("s"))
    kept = opened.where("not pre and r >= l").select(id, "label", "l", "r", "level")
    return kept.join(firsts, [id, "level", "l"], "left").select(id, "label", "l", F.coalesce("s", F.col("r")).alias("s"), "r")


def typed_balance(df: DataFrame, id: str = "parse_id", tree: str = "tree") -> DataFrame:
    """(id, markers, roots, valid) of typed marker arrays: valid if openings and closings pair up and
    each pair has one label, so crossed brackets are found. At one level openings and closings
    alternate: the pairs are the first and second, the third and fourth marker there. Arrays without
    markers are valid; null arrays and null ids are left out."""
    m = df.where(F.col(id).isNotNull()).select(id, F.posexplode(tree).alias("i", "t")).where(~is_leaf(F.col("t")))
    m = m.select(id, "i", F.when(is_open(F.col("t")), 1).otherwise(-1).alias("step"), F.regexp_extract("t", r"^<\(?(.*?)\)?>$", 1).alias("label"))
    w = Window.partitionBy(id).orderBy("i")
    m = m.withColumn("depth", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("level", F.when(F.col("step") == -1, F.col("depth") + 1).otherwise(F.col("depth")))
    m = m.withColumn("before", F.lag("label").over(Window.partitionBy(id, "level").orderBy("i")))
    wrong = (F.col("depth") < 0) | ((F.col("step") == -1) & ~F.coalesce(F.col("before") == F.col("label"), F.lit(False)))
    told = m.groupBy(id).agg(F.count("*").alias("markers"), F.count_if((F.col("step") == 1) & (F.col("depth") == 1)).alias("roots"), (F.count_if(wrong) + F.abs(F.sum("step"))).alias("_bad"))
    known = df.where(F.col(id).isNotNull() & F.col(tree).isNotNull()).select(id).distinct()
    return known.join(told, id, "left").select(id, F.coalesce("markers", F.lit(0)).alias("markers"), F.coalesce("roots", F.lit(0)).alias("roots"), (F.coalesce("_bad", F.lit(0)) == 0).alias("valid"))
