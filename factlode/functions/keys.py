"""One spelling for company codes and filing identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The full-width forms of printable ASCII and the ideographic space.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF = "".join(map(chr, range(0x21, 0x7F))) + " "


def fold_width(c: Column) -> Column:
    """Full-width ASCII and the ideographic space as plain ASCII."""
    return F.translate(c, FULL, HALF)


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.upper(fold_width(c)), r"(?U)\s+", "")


def company_code(c: Column) -> Column:
    """Four digits of a company code, whatever its width, padding, market mark or lost leading zeros; null where there is none."""
    digits = F.regexp_extract(_plain(c), r"^(?:TW[-_]?)?([0-9]{1,4})(?:[-_.]?TW)?$", 1)
    return F.when(digits != "", F.lpad(digits, 4, "0"))


def filing_id(c: Column) -> Column:
    """``<code>-FY<year>-<suffix>`` of a filing, whatever its case, width, separators or file ending; text of another form comes back folded;
    blank is null."""
    t = F.regexp_replace(F.regexp_replace(_plain(c), r"\.PDF$", ""), "[_–—‐-]+", "-")
    parts = [F.regexp_extract(t, r"^(?:TW-?)?([0-9]{1,4})-?FY([0-9]{4})-?([A-Z0-9]+)$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat(F.lpad(parts[0], 4, "0"), F.lit("-FY"), parts[1], F.lit("-"), parts[2])).when(t != "", t)


def filing_company(filing: Column) -> Column:
    """The company code in a filing identifier of :func:`filing_id`; null where it has none."""
    code = F.regexp_extract(filing, "^([0-9]{4})-FY[0-9]{4}-", 1)
    return F.when(code != "", code)
