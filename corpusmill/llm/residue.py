"""Template residue, filler text, error pages and script notices in documents.

Method: character n-gram models are fitted for filler (stand-in text and unfilled slots), for
error and script notices, and for natural content (prose for the most part). Windows of a text in which a residue model is
likelier than prose by a margin localise the residue. A document is excluded by coverage: when
windows cover a line, a sentence, a long stretch, or a slot. An exact check follows for slots (of
the form of a template language, neither quoted nor in a sentence about markup).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import residue_seeds
from corpusmill.session import spread

_KEPT = " .,!:'\"`-()[]{}<>$%#@&_=/"
#: a-z, other letters, digits, line ends, the kept marks, other marks
SIZE = 26 + 1 + 1 + 1 + len(_KEPT) + 1
_LETTER, _DIGIT, _END, _OTHER = 26, 27, 28, SIZE - 1
_BLANK, _DOT, _BANG = (29 + _KEPT.index(_c) for _c in " .!")
_LUT = np.full(256, _OTHER, np.uint8)
for _k in range(26):
    _LUT[97 + _k] = _LUT[65 + _k] = _k
for _k in range(10):
    _LUT[48 + _k] = _DIGIT
for _k, _c in enumerate(_KEPT):
    _LUT[ord(_c)] = 29 + _k
_LUT[ord("?")], _LUT[ord(";")], _LUT[ord("\t")], _LUT[10], _LUT[ord("|")], _LUT[ord("\\")] = _LUT[ord("!")], _LUT[ord(",")], _LUT[32], _END, _LUT[ord("/")], _LUT[ord("/")]
_LUT[0xC0:] = _LETTER  # first byte of a longer character; the others are dropped
_LUT_BYTES, _REST = _LUT.tobytes(), bytes(range(0x80, 0xC0))
_SPACES = re.compile(" {2,}")
#: Kinds of space and of quotes, and what they are read as.
_PLAIN = [(c, " ") for c in map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))] + list(zip("“”„«»‘’‚´–—", "\"\"\"\"\"''''--"))
ORDER, CLIP, SCALE = 4, 6.0, 20.0
GRAMS = SIZE**ORDER
#: Characters of the texts that are scored or counted at once.
CHUNK = 1 << 20
#: Characters that the texts weigh in the models against seeds and fall-back, as many as the thresholds below were
#: chosen with: all texts count, each less the more there are, so a corpus repeated gives the same models.
WEIGHT = 3_000_000


def normal(text: str) -> str:
    """One kind of space and of quotes, single spaces; places of lines stay."""
    if not text.isascii():
        for odd, plain in _PLAIN:
            text = text.replace(odd, plain)
    text = text.replace("\t", " ")
    if "  " in text:
        text = _SPACES.sub(" ", text)
    return text.replace("\r", "\n")


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not text.isascii():
        raw = raw[(raw & 0xC0) != 0x80]
    return _LUT[raw]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of normal texts, each followed by three line ends, and the number of the n-gram that ends at
    each. A line begins after line ends only, whatever stands before it: so it is scored as it was counted."""
    c = codes("\n\n\n" + "".join([t + "\n\n\n" for t in texts]))
    a, b, last = c[:-3].copy(), c[1:-2].copy(), c[2:-1]
    b[last == _END] = _END
    a[b == _END] = _END
    idx = a.astype(np.int32)
    for x in (b, last, c[3:]):
        idx *= SIZE
        idx += x
    return c[3:], idx


def chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Lists of texts of about CHUNK characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def counted(texts: list[str]) -> np.ndarray:
    """How often each n-gram stands in texts."""
    return np.bincount(grams([normal(t) for t in texts])[1], minlength=GRAMS)


class Model:
    """Interpolated character n-grams: each order falls back on the next lower one."""

    def __init__(self, texts: list[str] | np.ndarray, fall: float = 4.0):
        """Of texts, or of counts of their n-grams, which can be added."""
        full = texts if isinstance(texts, np.ndarray) else counted(texts)
        p = np.full(SIZE, 1.0 / SIZE)
        for n in range(1, ORDER + 1):
            counts = full.reshape(-1, SIZE**n).sum(0).reshape(-1, SIZE).astype(np.float32)
            base = p.reshape(-1, SIZE) if n > 1 else p[None, :]
            low = np.tile(base, (counts.shape[0] // base.shape[0], 1)) if n > 1 else base
            p = ((counts + fall * low) / (counts.sum(1, keepdims=True) + fall)).astype(np.float32).reshape(-1)
        self.p = p


def ratio(model: Model, prose: Model) -> np.ndarray:
    """Log-likelihood ratio of each n-gram's last character, as small integers."""
    return np.round(np.clip(np.log(model.p) - np.log(prose.p), -CLIP, CLIP) * SCALE).astype(np.int8)


Tables = tuple[np.ndarray, np.ndarray]


def _key(line: str) -> bytes:
    """The codes of a line, as codes() has them."""
    return line.strip().encode("utf-8", "replace").translate(_LUT_BYTES, _REST)


@cache
def _seeds() -> dict[bytes, int]:
    return {_key(normal(x)): k for k, own in ((1, residue_seeds.fillers()), (2, residue_seeds.notices())) for t in own for x in t.split("\n")}


def lines(texts: list[str], tables: Tables | None) -> tuple[list[str], list[str], list[str]]:
    """Lines of natural content, of filler and of notices in normal texts: all lines of a text that is a
    notice for its larger part are residue. Without tables every line is content that isn't a seed of
    residue itself, however often it stands there."""
    clean, filler, notice = out = [], [], []
    if tables is None:
        known = _seeds()
        for t in texts:
            for x in t.split("\n"):
                if x and not x.isspace():
                    out[known.get(_key(x), 0)].append(x)
        return out
    for t, found in zip(texts, located(texts, *tables)):
        if not found:
            clean += [x for x in t.split("\n") if x and not x.isspace()]
            continue
        page = _size([s for s in found if s[2] == "notice"]) > 0.5 * len(t)
        at = 0
        for x in t.split("\n"):
            own = {k for p, q, k in found if k != "slot" and p <= at and at + len(x) <= q}
            if own or page:
                (filler if "filler" in own else notice).append(x)
            elif x.strip() and not any(p < at + len(x) and at < q for p, q, _ in found):
                clean.append(x)
            at += len(x) + 1
    return out


def summed(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers."""
    one, at = np.unique(np.concatenate([np.zeros(0, np.int32), *keys]), return_inverse=True)
    total = np.zeros(len(one), np.int64)
    np.add.at(total, at, np.concatenate([np.zeros(0, np.int64), *numbers]))
    return one, total


def tally(texts: Iterable[str], tables: Tables | None) -> tuple[np.ndarray, np.ndarray]:
    """How often each n-gram stands in the lines of each kind (0 content, 1 filler, 2 notice) of normal
    texts; the key is kind * GRAMS + n-gram."""
    keys, numbers, held = [], [], 0
    for part in chunks(texts):
        for kind, own in enumerate(lines(part, tables)):
            if own:
                key, number = np.unique(grams(own)[1], return_counts=True)
                keys.append(key + np.int32(kind * GRAMS)), numbers.append(number)
                held += len(key)
        if held > 4_000_000:
            key, number = summed(keys, numbers)
            keys, numbers, held = [key], [number], 0
    return summed(keys, numbers)


def learn(count: Callable[[Tables | None], tuple[np.ndarray, np.ndarray]], rounds: int = 2) -> Tables:
    """Ratios of filler and of notices to natural prose. count: tally() of the texts by the given ratios.

    The models begin with residue_seeds and learn the wording of the texts: in each round their lines
    are told apart by the models so far; residue joins the text that its model is fitted on, with all
    lines of a text that is residue for its larger part, and what is left is what prose is fitted on.
    Only counts of n-grams are held, whatever the number of texts."""
    seeds = [grams([normal(t) for t in x])[1] for x in (residue_seeds.PROSE, residue_seeds.fillers(), residue_seeds.notices())]
    tables, size = None, 0
    for _ in range(rounds + 1):
        key, number = count(tables)
        size = size or max(WEIGHT, int(number.sum()))
        models = []
        for kind, seed in enumerate(seeds):
            counts = np.bincount(seed, minlength=GRAMS).astype(np.float64)
            own = key // GRAMS == kind
            counts[key[own] - kind * GRAMS] += number[own] * WEIGHT / size
            models.append(Model(counts))
        tables = ratio(models[1], models[0]), ratio(models[2], models[0])
    return tables


def fit(texts: list[str], rounds: int = 2) -> Tables:
    """learn() from texts."""
    return learn(lambda tables: tally(map(normal, texts), tables), rounds)


def fit_table(docs: DataFrame, text: str = "text", rounds: int = 2) -> Tables:
    """learn() from every text of a table, whole: it is read once a round and once before, and the
    counts are summed on the executors; the driver gets one row for each n-gram that occurs."""
    texts, spark = spread(docs.select(text).where(F.col(text).isNotNull())), docs.sparkSession

    def count(tables: Tables | None) -> tuple[np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast(tables)
        got = texts.mapInArrow(_tallied(sent), "key int, number bigint").groupBy("key").agg(F.sum("number").alias("number")).toArrow()
        sent.destroy()
        return got.column("key").to_numpy(), got.column("number").to_numpy()

    return learn(count, rounds)


#: Widths of the windows, and the mean log ratio a character that a window needs.
NARROW, WIDE, MARGIN = 8, 24, 0.35
#: Share of a line that windows must cover, and the log ratio of the whole line at least.
COVER, LINE_SCORE, FILLER_SCORE = 0.5, 5.0, 9.0
#: Characters of an unbroken stretch of filler that is residue inside a longer line.
STRETCH = 70
#: Log ratio and covered share of a sentence of a notice inside a line of several sentences.
SENTENCE_SCORE, SENTENCE_COVER = 12.0, 0.8
_ID = r"[^\W\d_][\w.\-]{1,40}"
#: Forms of slots in common template languages.
FORMS = [
    r"\{\{\{? ?[#/^>]?" + _ID + r"(?: ?\|[^{}\n]{1,60})? ?\}\}\}?",
    r"\{%-? ?[a-z]+(?: [^{}%\n]{1,60})? ?-?%\}",
    r"<%[=#-]? ?[^<>%\n]{2,60}%>",
    r"<\?(?:=|php echo) ?\$?" + _ID + r"[^<>\n]{0,30}\?>",
    r"[$#]\{" + _ID + r"\}",
    r"(?<![\w\\}^$#{])\{" + _ID + r"[\w\-]\}(?!\})",
    r"@@" + _ID + r"@@",
    r"(?<![\w.])__[^\W\d_][\w\-]{1,40}?__(?![\w(.])",
    r"(?<![\w%$])%%?" + _ID + r"[\w\-]%%?(?![\w%$])",
    r"%\(" + _ID + r"\)s",
    r"(?<![\w$\\])\$" + _ID + r"[\w\-]\$(?![\w$])",
    r"(?<!\w)\[\[ ?[^\W\d_][\w .\-]{1,40}\]\]",
    r"\[%" + _ID + r"%\]",
    r"\*\|" + _ID + r"\|\*",
    r"\[(?:insert|your|enter|add|put|type|choose|select)\b[^\[\]\n]{2,50}\]",
    r"<(?:insert|your|enter|add|put|type|choose|select)\b[^<>\n]{2,50}>",
    r"&lt; ?[^\W\d_][\w \-]{1,40} ?&gt;",
]
_SLOT = re.compile("|".join(FORMS), re.IGNORECASE)
#: Words of those who write about markup: a slot in such a sentence is spoken of.
_ABOUT = re.compile(r"\b(?:templates?|placeholders?|variables?|syntax|notation|shells?|commands?|code|macros?|tags?|strings?|regex|expressions?|arrays?|index(?:es)?|braces?|brackets?|escaped?|engines?|parameters?|operators?|functions?|environment|literal(?:ly)?|written as)\b", re.IGNORECASE)
_QUOTED = re.compile(r"(?<!\w)([\"`])[^\"`\n]{3,200}\1(?!\w)")
_MARKED = re.compile(r"[{}%\[\]<>&@|]|__|\$.")
_STOP = re.compile(r"[.!?\n](?=\s|$)|\n")


def _slot(text: str, start: int, stop: int) -> bool:
    """Whether a slot stands for itself: neither quoted nor in a sentence about markup."""
    left, right = text[start - 1 : start], text[stop : stop + 1]
    if left and left in "`'\"\\" and right and right in "`'\"\\":
        return False
    before = _STOP.split(text[max(0, start - 160) : start])[-1]
    after = _STOP.split(text[stop : stop + 160], maxsplit=1)[0]
    return not (_ABOUT.search(before) or _ABOUT.search(after))


def windows(scores: np.ndarray, width: int) -> np.ndarray:
    """Which characters lie in a window whose mean ratio reaches the margin."""
    n = len(scores)
    w = min(width, n)
    total = np.concatenate([[0], np.cumsum(scores, dtype=np.int32)])
    at = np.flatnonzero(total[w:] - total[:-w] >= MARGIN * SCALE * w)
    if not len(at):
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1
    edge[at + w] -= 1
    return np.cumsum(edge[:-1]) > 0


def spans(text: str, filler: np.ndarray, notice: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of each residue in a normal text: kinds slot, filler and notice."""
    c, idx = grams([text])
    c, idx = c[:-3], idx[:-2]
    if len(c) < 4:
        return []
    f, g = filler[idx], notice[idx]  # one more than c: a line has its end, the last one too
    if '"' in text or "`" in text:  # what is quoted in a longer line doesn't speak for residue
        f, g = f.copy(), g.copy()
        for m in _QUOTED.finditer(text):
            begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            if m.end() - m.start() < 0.8 * ((end if end >= 0 else len(text)) - begin):
                for scores in (f, g):
                    np.minimum(scores[m.start() : m.end()], 0, out=scores[m.start() : m.end()])
    out: list[tuple[int, int, str]] = []
    if _MARKED.search(text):  # windows of the filler model propose, the form is checked
        lit = windows(f[:-1], NARROW)
        for m in _SLOT.finditer(text):
            if lit[m.start() : m.end()].mean() >= 0.5 and _slot(text, m.start(), m.end()):
                out.append((m.start(), m.end(), "slot"))
    starts = np.concatenate([[0], np.flatnonzero(c == _END) + 1])
    stops = np.concatenate([starts[1:] - 1, [len(c)]])
    total = np.concatenate([[0], np.cumsum(f, dtype=np.int64)]), np.concatenate([[0], np.cumsum(g, dtype=np.int64)])
    sums = [t[stops + 1] - t[starts] for t in total]
    sizes = stops - starts
    whole = np.zeros(len(starts), bool)
    for kind, scores, own, least in (("notice", g, sums[1], LINE_SCORE), ("filler", f, sums[0], FILLER_SCORE)):
        for k in np.flatnonzero((own >= least * SCALE) & (sizes >= (8 if kind == "notice" else 10)) & ~whole).tolist():
            a, b = int(starts[k]), int(stops[k])
            if windows(scores[a:b], WIDE).mean() >= COVER:
                out.append((a, b, kind))
                whole[k] = True
    wide = windows(f[:-1], WIDE)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], wide.view(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= STRETCH and not any(x <= a and b <= y for x, y, k in out if k != "slot"):
            out.append((a, b, "filler"))
    return sorted(out + _sentences(text, c, g, total[1], starts[~whole]))


def _sentences(text: str, c: np.ndarray, g: np.ndarray, total: np.ndarray, lines: np.ndarray) -> list[tuple[int, int, str]]:
    """Notices that are a sentence of a line of several; a sentence that opens or ends with a quote is none."""
    cuts = np.flatnonzero(((c[:-1] == _DOT) | (c[:-1] == _BANG)) & (c[1:] == _BLANK)) + 1
    if not len(cuts):
        return []
    ends = np.flatnonzero(c == _END)
    starts = np.unique(np.concatenate([[0], ends + 1, cuts + 1]))
    starts = starts[starts < len(c)]
    stops = np.concatenate([starts[1:] - 1, [len(c)]])
    alone = np.isin(starts, np.concatenate([[0], ends + 1])) & np.isin(stops, np.concatenate([ends, [len(c)]]))
    score = total[stops] - total[starts]
    out = []
    for k in np.flatnonzero((score >= SENTENCE_SCORE * SCALE) & (stops - starts >= 20) & ~alone).tolist():
        a, b = int(starts[k]), int(stops[k])
        line = ends.searchsorted(a)
        begin = int(ends[line - 1]) + 1 if line else 0
        if begin in lines and windows(g[a:b], WIDE).mean() >= SENTENCE_COVER and not any(q in text[a:b] + text[a - 1 : a] + text[b : b + 1] for q in '"`'):
            out.append((a, b, "notice"))
    return out


#: What every form of FORMS begins with.
_OPEN = re.compile(r"[{<$#@_%\[*&]")


def located(texts: list[str], filler: np.ndarray, notice: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """spans() of each of many normal texts. All are scored at once first, and only texts that can have a
    residue go through spans(): those with a slot's form, or with a line, a sentence or a stretch that
    reaches its score when quotes are overlooked, which only lower scores."""
    if not texts:
        return []
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    c, idx = grams(texts)
    begins = np.cumsum([0] + [len(t) + 3 for t in texts])[:-1]
    f, g = (np.concatenate([[0], np.cumsum(t[idx], dtype=np.int64)]) for t in (filler, notice))
    end = c == _END
    stop = np.flatnonzero(end)
    start = np.concatenate([[0], stop[:-1] + 1])
    size = stop - start
    line = (g[stop + 1] - g[start] >= LINE_SCORE * SCALE) & (size >= 8) | (f[stop + 1] - f[start] >= FILLER_SCORE * SCALE) & (size >= 10)
    end[1:] |= (c[1:] == _BLANK) & ((c[:-1] == _DOT) | (c[:-1] == _BANG))
    stop = np.flatnonzero(end)
    first = np.concatenate([[0], stop[:-1] + 1])
    sentence = (g[stop] - g[first] >= SENTENCE_SCORE * SCALE) & (stop - first >= 20)
    at = [start[line], first[sentence]]
    lit = np.flatnonzero(f[WIDE:] - f[:-WIDE] >= MARGIN * SCALE * WIDE)
    if len(lit):
        cut = np.flatnonzero(np.diff(lit) > WIDE)
        a, b = lit[np.concatenate([[0], cut + 1])], lit[np.concatenate([cut, [len(lit) - 1]])] + WIDE
        for x, y in zip(a[b - a >= STRETCH].tolist(), b[b - a >= STRETCH].tolist()):
            at.append(np.concatenate([[x], begins[(begins > x) & (begins < y)]]))
    whole = "\n\n\n".join(texts)
    at.append(np.array([m.start() for m in _OPEN.finditer(whole) if _SLOT.match(whole, m.start())], np.int64))
    del c, idx, f, g, end
    for k in np.unique(begins.searchsorted(np.concatenate(at), "right") - 1).tolist():
        out[k] = spans(texts[k], filler, notice)
    return out


def _size(found: list[tuple[int, int, str]]) -> int:
    """Characters in any of the spans, which are in order of their starts."""
    total = end = 0
    for a, b, _ in found:
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _found(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, chars, sizes, first = [], [], [], []
            for texts in chunks(normal(t) if t else "" for t in batch.column(1).to_pylist()):
                for text, got in zip(texts, located(texts, *tables.value)):
                    kinds.append(sorted({k for _, _, k in got})), chars.append(_size(got)), sizes.append(len(text))
                    first.append(text[got[0][0] : got[0][1]][:200] if got else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(chars, pa.int64()), pa.array([c / s if s else 0.0 for c, s in zip(chars, sizes)], pa.float64()), pa.array(first, pa.string())], ["id", "kinds", "chars", "coverage", "first"])

    return run


def _tallied(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number = tally((normal(t) for batch in batches for t in batch.column(0).to_pylist()), tables.value)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(number, pa.int64())], ["key", "number"])

    return run


def residue(docs: DataFrame, labels: DataFrame | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kinds, chars, coverage, first) of every row: the kinds of residue, how many characters
    and which share of the text they cover, and the first one. The models are fitted on every text
    of docs, labelled or not, so `labels` changes nothing. Null, empty, blank and very short
    texts have none; repeated rows and null ids stay. Extra columns are ignored."""
    tables = docs.sparkSession.sparkContext.broadcast(fit_table(docs, text))
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(_found(tables), f"`{id}` {kind}, kinds array<string>, chars bigint, coverage double, first string")
