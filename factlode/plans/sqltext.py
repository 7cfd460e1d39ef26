"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from factlode.functions.keys import FULL, HALF
from factlode.functions.text import CJK, NARROW, WIDE, WORD
from factlode.operators.pages import WHITE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(c: str) -> str:
    return f"translate({c}, {q(FULL)}, {q(HALF)})"


def no_space(c: str) -> str:
    return f"regexp_replace({c}, '[\\x{{9}}-\\x{{D}}\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', '', 'g')"


def no_white(c: str) -> str:
    return f"regexp_replace({c}, '[{WHITE}]', '', 'g')"


def bigrams(c: str) -> str:
    return f"case when length({c}) > 1 then list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)) when length({c}) = 1 then [{c}] else [] end"


def tokens(c: str) -> str:
    runs = f"regexp_extract_all(translate(nfc_normalize({c}), {q(WIDE)}, {q(NARROW)}), '((?:{WORD})|[{CJK}]+)')"
    return f"coalesce(flatten(list_transform({runs}, lambda m: case when regexp_matches(m, '^[0-9A-Za-z]') then [lower(m)] when length(m) = 1 then [m] else list_transform(range(1, length(m)), lambda i: substring(m, i, 2)) end)), [])"


def gram_set(c: str) -> str:
    t = f"replace(lower({no_space(c)}), 'ß', 'ss')"
    return f"list_distinct({bigrams(t)})"


def _plain(c: str) -> str:
    return no_space(f"upper({fold(c)})")


def company_code(c: str) -> str:
    d = f"regexp_extract({_plain(c)}, '^(?:TW[-_]?)?([0-9]{{1,4}})(?:[-_.]?TW)?$', 1)"
    return f"case when {d} <> '' then lpad({d}, 4, '0') end"


def filing_id(c: str) -> str:
    t = f"regexp_replace(regexp_replace({_plain(c)}, '\\.PDF$', ''), '[_–—‐-]+', '-', 'g')"
    p = [f"regexp_extract({t}, '^(?:TW-?)?([0-9]{{1,4}})-?FY([0-9]{{4}})-?([A-Z0-9]+)$', {i})" for i in (1, 2, 3)]
    return f"case when {p[0]} <> '' then lpad({p[0]}, 4, '0') || '-FY' || {p[1]} || '-' || {p[2]} when {t} <> '' then {t} end"


def canonical_unit(c: str) -> str:
    t = f"trim({fold(c)}, ' ')"
    from factlode.operators.facts import ALIASES

    cases = " ".join(f"when {q(a)} then {q(b)}" for a, b in ALIASES.items())
    return f"case when {t} <> '' then case {t} {cases} else {t} end end"


CHUNKS = "(select chunk_id, any_value(doc_id) doc_id, any_value(text) text, any_value(pages) pages, any_value(section_path) section_path, any_value(parser) parser from chunk where chunk_id is not null group by chunk_id)"
GOLD = "(select question_id, any_value(question_set) question_set, any_value(question_type) question_type, any_value(question) question, any_value(company) company, any_value(period) period, any_value(source_document) source_document, any_value(page_numbers) page_numbers, any_value(answerable) answerable, any_value(tolerance) tolerance, any_value(unit) unit, any_value(audited) audited, any_value(answer) answer from gold where question_id is not null group by question_id)"
