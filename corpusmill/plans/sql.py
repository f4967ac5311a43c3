"""Pieces of DuckDB SQL that several oracles use."""

from __future__ import annotations

SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + SPACE + "]"
ESCAPES = [("-LRB-", "("), ("-RRB-", ")"), ("-LCB-", "{"), ("-RCB-", "}"), ("-LSB-", "["), ("-RSB-", "]")]


def replaced(text: str, pairs: list[tuple[str, str]] = ESCAPES) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')"
    return text


def tokens(text: str) -> str:
    return f"regexp_extract_all(replace(lower({replaced(text)}), 'ς', 'σ'), '{TOKEN}')"


def body(text: str) -> str:
    return f"array_to_string({tokens(text)}, ' ')"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'))"


def content_key(text: str) -> str:
    return f"sha256({squeezed(f'nfc_normalize({text})')})"


#: documents with a usable text, and their grams of n words: docs(doc_id, source, ws, n), g(doc_id, source, pos, gram)
DOCS = f"docs as (select doc_id, source, source_row, text, {tokens('text')} ws from documents where text is not null)"


def grams(n: int, name: str = "g", of: str = "docs") -> str:
    return f"{name} as (select doc_id, source, i pos, array_to_string(ws[i:i + {n - 1}], ' ') gram from (select doc_id, source, ws, unnest(range(1, len(ws) - {n - 2})) i from {of} where len(ws) >= {n}))"
