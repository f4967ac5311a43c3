"""Examples of the classes that the formula rules tell apart, our own wording."""

from __future__ import annotations

import pytest

from corpusmill.functions import formulas as M

KEPT = [
    "In 1994 sales fell 3.1% to $14 million. Tickets cost $8 and $9 on Oct. 12.",
    "Patients were given 4 mg/kg; in the trial (n=88), p = 0.01 and OR = 1.9; 95% CI 1.1-3.4.",
    "The survey (n=30) looked at E. coli. The limit was 0/50 ml.",
    "Estimates of growth: a=0.012 (0.008 - 0.019), b=2.9 (2.7 - 3.1).",
    "Kd / Km = 2 was reported.", "The glider has L / D=30.", "Those in the group (n = 7/12) were seen again.", "Score = 9/10.",
    "$ 12.50 Pesos = $ 1 US.", "Yen = 1/100 of the old unit.", "A short time (1 ns = 10 - 9 s).",
    "$ 20 (USD) entry fee and a = $ 5 voucher.", "The arrays $ _ SERVER, $ _ FILES and $ _ ENV are set.",
    "id=’99ab - 12cd′]", "-LRB-n = 41-RRB-|", "N=7||Adults aged 20 - 35.", "P=.04). Deaths fell from 8.1 to 3.",
    "Mean = 7.2 μm; Cin = 2 μF.", "date=3 May 2011 |retrieved 2012 - 01 - 02", "Cache-control: max - age=600", "8 K (UHD) = 7680×4320 (4320p) resolution.",
    "$status == 1 goto end; if $status != 0 goto start", "$2 = us$ 1.40", "$ [url = http://example.com/a]Go-0.2$", "A chain of -CH = CH-(CH2)3-COOH.",
    "CO2 and NH3 were measured at 21°C, 110/70 mmHg.", "Teachers of algebra and geometry need patience.", "See https://example.com/?id=7&x=1+2. The word fons = a spring.", "",
]
DROPPED = [r"Take \frac{a}{b+1}.", r"\begin{equation} a+b = c \end{equation}", r"so \sum_{k} holds", "<math><mi>y</mi></math>", "$a+b=c$", "$$x_1 + x_2$$", "The equation a + b = 7 is simple.", "We write E = mc^2.", "QZ = 30/40 * 20/25", "The flow follows the formula Q = kΔP.", "The equation r = √50/10 is used.", "∫ f dx"]
REVIEWED = ["function twice(x) { const y = x + 2; return y; }", "The equation has a coefficient. Let k = b."]


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert M.decide(M.signals(text)) == "keep"


@pytest.mark.parametrize("text", DROPPED)
def test_dropped(text):
    assert M.decide(M.signals(text)) == "drop"


@pytest.mark.parametrize("text", REVIEWED)
def test_reviewed(text):
    assert M.decide(M.signals(text)) == "review"


def test_ranges_and_code_are_not_dropped():
    for text in ["Group A = 20 - 25 years old.", "def add-LRB-y-RRB-: x = 1; x = x + y"]:
        assert M.decide(M.signals(text)) != "drop"


def test_places_are_those_of_the_text():
    text = "so -LRB-as said-RRB- the equation x + y = 3, it is"
    (s,) = M.signals(text)
    assert text[s.start : s.end] == "x + y = 3" and s.kind == "equation_expression" and s.confirmed


def test_expression_prefix():
    assert M.expression_prefix("mc^2 + 3 which holds") == "mc^2 + 3" and M.expression_prefix("sin(x) of the angle") == "sin(x)" and M.expression_prefix("revenue for") == ""


def test_null_and_long():
    assert M.signals(None) == [] and M.decide(M.signals("a = b\n" * 50_000)) in ("keep", "review")
