"""Visible signals of text quality. Phrases and marks are plain tables; expressions are built from them.

Expressions that SQL shares read alike in Java and RE2; where only look-around can say it, the rule has
an expression of its own for Spark and the SQL says the same in another way.
"""

from __future__ import annotations

import re

from corpusmill.functions import formulas as _M

# Phrases of web pages around their content, of notices about the text, and of page controls.
# [word] may be missing, a|b is either, ... is some other text of the same sentence.
BOILERPLATE = [
    "accept [all] cookies", "reject [all] cookies", "cookie settings|preferences|consent|policy", "this website|site use|uses cookies", "we use|uses cookies", "by using|continuing|browsing ... cookies",
    "manage [your] consent", "manage [your] cookie preferences", "skip to [main] content", "your email address will not be published", "leave a reply", "log in to comment|continue", "login to comment|continue",
    "enable javascript", "javascript is disabled", "subscribe to our|the newsletter",
]
WARNINGS = ["uncorrected ocr|machine", "machine|automatically extracted text", "machine-extracted|automatically-extracted text", "ocr errors|artefacts|artifacts", "this|the text|document|transcription ... not [been] proofread|corrected"]
CONTROLS = ["skip to [main] content", "accept all cookies", "cookie settings|preferences", "enable javascript", "javascript is disabled", "subscribe to our newsletter", "leave a reply", "your email address will not be published", "log in to comment|continue"]
UNCORRECTED = ["uncorrected machine-read text", "uncorrected machine - read text", "uncorrected material"]
# Names of tags, of fields in citations, of entities and of phrase labels; of functions below.
RAW_TAGS = "html body script iframe div table tr td".split()
SHOWN_TAGS = "div p span a br ul li table td tr html body script style h1 h2 h3 h4 h5 h6".split()
CITATION_FIELDS = "url title date publisher accessdate archiveurl author doi isbn".split()
ENTITIES = "amp nbsp lt gt quot apos".split()
LABELS = "ADJP ADVP CONJP FRAG INTJ LST NAC NML NP PP PRN PRT QP RRC S SBAR SBARQ SINV SQ UCP VP WHADJP WHADVP WHNP WHPP X".split()
# How code begins; NAME is an identifier, spaces may be any or none but after a word.
CODE = ["def NAME (", "function NAME (", "public static ", "console . log (", "# include <"]
FUNCTIONS = "ln log exp sin cos tan sqrt".split()
# Characters whose bytes show when UTF-8 is read as a Western code page.
LETTERS, SIGNS, PUNCTUATION = "üöäéñï", "£©®°", "’“”–—…"

_GAP = {"boilerplate": 100, "warning": 60}
_LATIN, _W = "A-Za-zΑ-Ωα-ω", r"\p{L}\p{N}_"


def phrase(words: str, gap: int = 60) -> str:
    """The expression of a phrase: words with any white space between them."""
    out = ""
    for k, word in enumerate(words.split()):
        if word == "...":
            out += rf"[^\n.]{{0,{gap}}}"
            continue
        joint = "" if not out or out.endswith("}") else r"\s+"
        optional = word.startswith("[")
        word = "|".join(map(re.escape, word.strip("[]").split("|")))
        word = f"(?:{word})" if "|" in word else word
        out += f"(?:{joint}{word})?" if optional else joint + word
    return out


def phrases(table: list[str], gap: int = 60) -> str:
    return r"(?i)\b(?:" + "|".join(phrase(p, gap) for p in table) + r")\b"


def damaged(text: str) -> list[str]:
    """Each character as its UTF-8 bytes read one by one, as Windows-1252 or else as Latin-1."""

    def read(byte: int) -> str:
        try:
            return bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(byte)

    return ["".join(map(read, c.encode())) for c in text]


def _split(found: list[str]) -> str:
    """Damaged characters of which the bytes may have come apart."""
    return "|".join(rf"{f[0]}\s*{f[1:]}" for f in found)


def tag(names: list[str], rest: str = "") -> str:
    return rf"(?i)<\s*/?\s*(?:{'|'.join(names)})\b{rest}"


def _call(name: str, inside: str) -> str:
    return rf"{name}\s*\({inside}\)"


def code(start: str) -> str:
    """The expression of a start of code."""
    parts = [r"[A-Za-z_][A-Za-z0-9_]*" if w == "NAME" else re.escape(w) for w in start.split()]
    out = parts[0] if not parts[0].isalpha() else rf"\b{parts[0]}"
    for before, part in zip(parts, parts[1:]):
        out += (r"\s+" if before.isalpha() and part[0] in "[pstuv" else r"\s*") + part
    return out + (r"\s+" if start.endswith(" ") else "")


_APPLIED = rf"(?:{'|'.join(FUNCTIONS)})"
#: A page is left out of the collection for these.
REASONS: dict[str, str] = {
    "function_equation": rf"(?:^|[^{_W}])" + _call(rf"[{_LATIN}]{{1,6}}", r"[^\n=]{1,45}") + rf"\s*=\s*(?:[a-zΑ-Ωα-ω]{{1,3}}\s*\(|{_APPLIED}\b|[-+]?\d|[√∑∫])",
    "web_boilerplate": phrases(BOILERPLATE, _GAP["boilerplate"]),
    "extraction_warning": phrases(WARNINGS, _GAP["warning"]),
    "mojibake": "(?:" + _split(damaged(LETTERS + SIGNS)) + r"|â\s*[€™œž])",
    "raw_html": tag(RAW_TAGS),
}
#: What a page shows; each is counted.
SIGNALS: dict[str, str] = {
    "uncorrected_machine_read_notice": phrases(UNCORRECTED),
    "replacement_character": r"\x{FFFD}",
    "control_character": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
    "mojibake_candidate": "|".join([r"Ã[\x{80}-\x{bf}]", *damaged(PUNCTUATION), *damaged(" " + SIGNS), damaged("\U0001f600")[0][:2]]),
    "literal_tree_marker": rf"<\((?:{'|'.join(LABELS)})>|<(?:{'|'.join(LABELS)})\)>",
    "split_contraction": r"\b[A-Za-z]+\s+(?:n['’]t|['’](?:s|re|ve|ll|d|m))\b",
    "space_before_punctuation": r"[A-Za-z0-9] +[,.!?;:](?:[\s\p{Z}]|$)",
    "html_entity_candidate": rf"(?i)&\s*(?:{'|'.join(ENTITIES)}|#\s*\d{{2,7}}|#x\s*[0-9A-F]{{2,6}})\s*;",
    "html_tag_candidate": tag(SHOWN_TAGS, r"[^<>\n]{0,200}>"),
    "wiki_citation_markup_candidate": r"(?i)\{\{|\}\}|\[\[[^\]\n]{1,100}\]\]" + rf"|\|\s*(?:{'|'.join(CITATION_FIELDS)})\s*=",
    "web_ui_phrase_candidate": phrases(CONTROLS),
    "code_syntax_candidate": "|".join(map(code, CODE)),
    "function_equation_candidate": r"(?i)\b" + _call(rf"[{_LATIN}][A-Za-z0-9_]{{0,3}}", r"[^()\n]{0,30}") + r"\s*=\s*" + _call(_APPLIED, r"[^()\n]{1,100}"),
    "ptb_bracket": r"-(?:LRB|RRB|LCB|RCB|LSB|RSB)-",
}
#: A pair of back quotes or of straight quotes by itself; with look-around, for Spark only.
PTB_QUOTE = rf"(?<![{_W}])(?:``|'')(?![{_W}])"
#: Formulas that marks alone show, whatever is around them.
FORMULAS: dict[str, str] = {
    "latex_environment": rf"\\\s*begin\s*\{{\s*(?:{'|'.join(_M.ENVIRONMENTS)})\*?\s*\}}",
    "latex_fraction_root": rf"\\\s*(?:{'|'.join(_M.FRACTIONS)})\s*\{{",
    "latex_calculus": rf"\\\s*(?:{'|'.join(_M.CALCULUS)})\s*[_^{{]",
    "mathml": r"(?i)<\s*(?:[a-z]+:)?math\b",
    "display_math": r"\$\$[^$]*[=^_∑∫√][^$]*\$\$",
    "inline_math": r"\$[^$\n]{0,90}[=^∑∫√][^$\n]{0,90}\$",
    "calculus_glyph": rf"[∑∏∫]\s*[{_LATIN}0-9(_^]",
}
