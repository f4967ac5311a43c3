"""Formulas in running text: signals with confidences, and a decision for the document.

A text is scanned for marks (LaTeX commands, MathML, dollars, sums and integrals), and every sign of
equality is read with what stands on its two sides: the left side is walked backwards operand by operand,
the right side forwards as far as it reads like mathematics. Statements that only look like equations
(measurements, prices, units, ratios, chemical chains, metadata, code) are let go by rules on the two sides.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Words near a formula, functions, words that end an expression, and names that aren't variables.
MATH_WORDS = "equation equations formula formulas formulae algebra algebraic calculus polynomial theorem derivative integral numerator denominator coefficient coefficients quadratic proportional logarithm exponent trigonometric matrix matrices vector vectors".split()
FUNCTIONS = "sqrt exp log sin cos tan pi ln".split()
PROSE = "is are was were and or the of in to for but can as at it by not has from then we".split()
CONNECTIVES = "where which with and is are means denotes represents because".split()
METADATA = "url date title symbol publisher retrieved accessdate link_id id iid isbn lang referer".split()
MONEY = "usd eur gbp dollar dollars peso pesos zloty yen yuan rupee rupees rand ringgit won fee price cost".split()
STATISTICS = "n p or hr rr ci sd se m df r2 r score".split()
UNITS = "fs ps ns us μs ms s mm cm m km mg g kg ml mL L mV V Hz kHz MHz".split()
UNIT_WORDS = "s second seconds m meter meters g gram grams kg mg V Hz L".split()
ENVIRONMENTS = "equation align eqnarray gather multline math displaymath".split()
FRACTIONS, CALCULUS = "frac dfrac tfrac sqrt binom".split(), "sum prod int iint iiint lim".split()
PRICED = "us hk si tt ec r".split()
# Characters to either side in which math words count, and lengths of delimited formulas.
NEAR, AROUND, DISPLAY, INLINE, PAREN, RIGHT, LISTED = 350, 300, 2500, 180, 500, 160, 20

_GREEK = "Α-Ωα-ω"
_LETTER, _OP, _SUPER, _NUM = f"A-Za-z{_GREEK}", r"+*/^×÷−\-", "²³⁴⁵⁶⁷⁸⁹", r"(?:\d+(?:\.\d+)?|\.\d+)"


def _words(names: list[str]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", re.IGNORECASE)


_MATH, _MONEY, _CONNECTIVE = _words(MATH_WORDS), _words(MONEY), _words(CONNECTIVES)
_CODE = re.compile(r"\b(?:(?:def|function)\s+\w+\s*\(|public\s+static\b|console\s*\.|printf\s*\(|(?:const|var)\s+\w+\s*=|import\s+\w)")
_OPENED = {"-LRB-": "(", "-LSB-": "[", "-LCB-": "{"}
_CLOSED = {"-RRB-": ")", "-RSB-": "]", "-RCB-": "}"}
_LATEX_OPERATION = re.compile(r"\\\s*(?:frac|sqrt|sum|int)")
_NUMERIC = re.compile(rf"(?<![\w.])\d+(?:\.\d+)?\s*([{_OP}])\s*\d+(?:\.\d+)?(?![\w.])")
_SYMBOLIC = re.compile(rf"(?<!\w)[{_LETTER}]{{1,3}}\s*[{_OP}]\s*(?:[{_LETTER}]{{1,3}}|\d+)(?!\w)")
_POWER = re.compile(rf"[{_LETTER}\d]\s*\^\s*[-+]?[\w{{]|[{_LETTER}][{_SUPER}]")
_STRONG = re.compile(r"[+*/^×÷]")
_VALUE = re.compile(rf"[-+]?{_NUM}(?:[eE][-+]?\d+)?\s*%?(?=[\s),.;|]|$)")
_FRACTION = re.compile(r"\d+\s*/\s*\d+(?!\w)")
_PIECE = re.compile(rf"\s*(?:(?P<name>[{_LETTER}][{_LETTER}0-9{_SUPER}]*)|(?P<other>{_NUM}|[_^{{}}()\[\]{_OP}√=.]))")


class Signal(NamedTuple):
    kind: str
    confirmed: bool
    start: int
    end: int


def _masked(text: str) -> str:
    """Bracket escapes as brackets, at the same width, so that places stay."""
    if "B-" in text:
        for escape, mark in _OPENED.items():
            text = text.replace(escape, mark.ljust(5))
        for escape, mark in _CLOSED.items():
            text = text.replace(escape, mark.rjust(5))
    return text


def _commands(text: str):
    for m in re.finditer(r"\\\s*([A-Za-z]+)", text):
        name, rest = m[1].lower(), text[m.end() : m.end() + 80]
        if name == "begin":
            kind, tail = "latex_environment", re.match(r"\s*\{\s*(?:" + "|".join(ENVIRONMENTS) + r")\*?\s*\}", rest, re.IGNORECASE)
        elif name in FRACTIONS:
            kind, tail = "latex_fraction_root", re.match(r"\s*(?:\[[^\]\n]{0,30}\]\s*)?\{", rest)
        elif name in CALCULUS:
            kind, tail = "latex_calculus", re.match(r"\s*(?:[_^{]|\\\s*(?:limits|infty))", rest)
        else:
            continue
        if tail:
            yield Signal(kind, True, m.start(), m.end() + tail.end())


def _delimited(text: str):
    """Formulas between dollars or LaTeX's own brackets."""
    for m in re.finditer(rf"\\\[[\s\S]{{1,{DISPLAY}}}?\\\]|\$\$[\s\S]{{1,{DISPLAY}}}?\$\$", text):
        if re.search(r"[=^_∑∫√]", m[0]) or _LATEX_OPERATION.search(m[0]):
            yield Signal("display_math", True, m.start(), m.end())
    for m in re.finditer(rf"\$[^$\n]{{1,{INLINE}}}\$|\\\([^\n]{{1,{PAREN}}}?\\\)", text):
        own, command = m[0], _LATEX_OPERATION.search(m[0])
        inside = own[1:].lstrip()
        priced = re.fullmatch(r"[\d][\d,.\s]*=\s*(?:" + "|".join(PRICED) + r")\s*\$", inside, re.IGNORECASE)
        variable = any(re.match(r"\s*(?:[A-Za-z]{2}|\[)", part) for part in own.split("$")[1:])
        if _MONEY.search(own) or "http" in own.lower() or priced or (variable and not command):
            continue
        if command or re.search(r"[=^∑∫√]", own):
            yield Signal("inline_math", True, m.start(), m.end())
        elif "_" in own and _MATH.search(text, max(0, m.start() - AROUND), m.end() + AROUND):
            yield Signal("inline_variable_notation", False, m.start(), m.end())


def _left(text: str, at: int) -> int | None:
    """Where the left side of an equality at `at` begins: up to four operands joined by operators, each
    a short name or a number, perhaps with an index or power, perhaps with something in brackets."""
    base = max(0, at - 400)
    own, begin = text[base:at], None
    for _ in range(4):
        own = own.rstrip()
        if own.endswith(")"):
            opened = own.rfind("(", max(0, len(own) - 47))
            if opened < 0 or "=" in own[opened:] or "\n" in own[opened:]:
                break
            own = own[:opened].rstrip()
        index = re.search(r"[_^]\s*[\w{}]+$", own[-40:])
        if index:
            own = own[: len(own) - len(index[0])].rstrip()
        operand = re.search(rf"(?<!\w)(?:[{_LETTER}]{{1,6}}|\d+(?:\.\d+)?)$", own[-40:])
        if not operand:
            break
        own = own[: len(own) - len(operand[0])]
        begin = base + len(own)
        own = own.rstrip()
        if not own or own[-1] not in "+*/^×÷−-":
            break
        own = own[:-1]
    return begin


def _right(text: str, at: int) -> str:
    """What follows an equality, to the end of its line, the next comma or a connecting word."""
    line = text[at : at + RIGHT + 80].lstrip(" \t")[:RIGHT].split("\n")[0]
    line = re.split(r"[,;]", line, maxsplit=1)[0]
    m = re.search(r"\s+(?:" + "|".join(CONNECTIVES) + r")\b", line, re.IGNORECASE)
    return (line[: m.start()] if m else line).strip()


def expression_prefix(right: str) -> str:
    """The part of a right side that reads like mathematics: numbers, marks, and short names, capitals
    or functions, up to the first word of prose."""
    end = 0
    while (m := _PIECE.match(right, end)) is not None:
        name = m["name"]
        if name and (name.lower() in PROSE or not (len(name) <= 3 or (name.isupper() and len(name) <= 6) or name in FUNCTIONS or re.search(f"[{_GREEK}{_SUPER}]", name))):
            break
        end = m.end()
    return right[:end].strip().rstrip(".")


def _excused(left: str, right: str, cues: int, around: str) -> bool:
    """Whether an equality is a statement of another kind."""
    value, fraction, low = _VALUE.match(right), _FRACTION.match(right), left.lower()
    goes_on = lambda m, marks: right[m.end() :].lstrip()[:1] in tuple(marks)
    if low in METADATA or low in MONEY:
        return True
    if low in STATISTICS and value and not goes_on(value, "+*/^×÷−-"):
        return True
    if re.match(r"[-+]?\d+(?:\.\d+)?\s*\(\s*\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\s*\)", right):  # an estimate and its interval
        return True
    if left in UNITS and re.match(r"\d+(?:\.\d+)?(?:\s*\^?\s*-\s*\d+)?\s+(?:" + "|".join(UNIT_WORDS) + r")\b", right):
        return True
    if cues:
        return False
    if low in STATISTICS and fraction and not goes_on(fraction, "+*/^×÷(−-"):
        return True
    if right[:1] in tuple("\"'’‘") or re.fullmatch(r"[A-Za-z]{2,6}\s*-\s*[A-Za-z]{2,6}", left):
        return True
    chain = re.compile(r"(?:CH\d*|COOH|OH|NH\d*|CO\d*)\b")
    if chain.match(left) and chain.match(right):
        return True
    return bool(re.match(r"\d+\s*[×x]\s*\d+", right) and re.search(r"\b(?:uhd|pixels?|resolution)\b", around, re.IGNORECASE))


def _equality(text: str, at: int) -> Signal | None:
    if text[at - 1 : at] in tuple("<>!:=") or text[at + 1 : at + 2] == "=":
        return None
    begin = _left(text, at)
    if begin is None:
        return None
    left, right = text[begin:at].strip(), _right(text, at + 1)
    around = text[max(0, begin - NEAR) : at + 1 + RIGHT + NEAR]
    cues = len({w.lower() for w in _MATH.findall(around)})
    if _excused(left, right, cues, around):
        return None
    shown = expression_prefix(right)
    if not shown or (not cues and re.fullmatch(rf"[{_LETTER}]{{1,6}}\s*/\s*[{_LETTER}]{{1,6}}", left) and re.fullmatch(rf"[-+]?{_NUM}", shown.strip("()[] "))):
        return None
    end = text.index(right[:1], at + 1) + len(shown)
    on_left = bool(_SYMBOLIC.search(left) or _NUMERIC.search(left) or _POWER.search(left))
    numbers, power = bool(_NUMERIC.search(shown)), bool(_POWER.search(shown))
    greek = bool(re.match(f"[{_LETTER}]", shown) and re.search(f"[a-zA-Z][{_GREEK}]|[{_GREEK}][a-zA-Z]", shown.split()[0]))
    if on_left or numbers or power or greek or _SYMBOLIC.search(shown):
        led = on_left and bool(cues or _STRONG.search(left)) and bool(re.match(rf"[-+(\d]|[{_LETTER}]{{1,3}}\b", shown))
        sure = led or (numbers and bool(_STRONG.search(shown))) or power or cues > 0 or greek
        return Signal("equation_expression", sure and not _CODE.search(around), begin, end)
    if cues >= 2 and re.fullmatch(rf"[{_LETTER}0-9 _{{}}().{_OP}]{{1,30}}", shown) and len(shown.split()) <= 5:
        return Signal("symbolic_equality", False, begin, end)
    return None


def signals(text: str | None) -> list[Signal]:
    """Signals of formulas in a text, none for a null one. Those that begin in a URL don't count."""
    if not text or not re.search(r"[\\<$=∑∏∫√^_]", text):
        return []
    shown = _masked(text)
    found: list[Signal] = []
    if "\\" in shown:
        found += _commands(shown)
    if "<" in shown:
        found += [Signal("mathml", True, m.start(), m.end()) for m in re.finditer(r"<\s*(?:\w+:)?math\b", shown, re.IGNORECASE)]
    if "$" in shown or "\\" in shown:
        found += _delimited(shown)
    if any(c in shown for c in "∑∏∫"):
        found += [Signal("calculus_glyph", True, m.start(), m.end()) for m in re.finditer(r"[∑∏∫]\s*[a-zΑ-Ωα-ω0-9(_^\\]", shown)]
    last = 0
    for m in re.finditer("=", shown):
        one = _equality(shown, m.start()) if m.start() >= last else None
        if one:
            found.append(one)
            last = one.end
    if "http" in shown.lower():
        links = [m.span() for m in re.finditer(r"https?://\S+", shown, re.IGNORECASE)]
        found = [s for s in found if not any(a <= s.start < b for a, b in links)]
    if not found:
        marked = re.finditer(r"[^\n]{0,100}[∑∏∫√][^\n]{0,100}", shown)
        found = [Signal("ambiguous_math_symbol", False, m.start(), m.end()) for m in marked if _MATH.search(shown, max(0, m.start() - AROUND), m.end() + AROUND)]
    return found


def decide(found: list[Signal]) -> str:
    """drop if a formula is confirmed, review if one is likely, else keep."""
    return "drop" if any(s.confirmed for s in found) else "review" if found else "keep"
