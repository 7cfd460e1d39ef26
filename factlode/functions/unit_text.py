"""Units of measure as texts state them: in a unit field, in a note, or in the label of a figure."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

MONEY, SHARES, PER_SHARE, RATIO = "money", "shares", "per_share", "ratio"


class Unit(NamedTuple):
    """kind: MONEY, SHARES, RATIO or None (a bare magnitude); currency: TWD, USD or None."""

    kind: str | None
    scale: int
    currency: str | None


#: Magnitudes, the longer names first.
MAGNITUDES = [("十億", 10**9), ("千萬", 10**7), ("仟萬", 10**7), ("百萬", 10**6), ("億", 10**8), ("萬", 10**4), ("千", 1000), ("仟", 1000), ("billion", 10**9), ("bn", 10**9), ("million", 10**6), ("mn", 10**6), ("thousand", 1000), ("'000", 1000), ("000s", 1000), ("m", 10**6), ("k", 1000)]
_ZH = r"(?:新?[臺台]幣|美金)?(?:十億|[千仟百]萬|億|萬|[千仟])?(?:美元|元|股)"
_EN = r"(?:(?:thousands|millions|billions)(?: of)? )?(?:new taiwan dollars|us dollars|u\.s\. dollars|dollars|shares|nt\$|us\$|ntd|usd|twd)"


def fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").lower().replace("臺", "台").strip()


@lru_cache(65536)
def parse_unit(text: str | None) -> Unit | None:
    """The unit that ``text`` is; None where it is blank or no unit."""
    t = re.sub(r"[\s()\[\]（）]+", "", fold(text)).replace("’", "'")
    if not t:
        return None
    if re.fullmatch(r"%|％|percent|百分比|倍|times|次|天|days", t):
        return Unit(RATIO, 1, None)
    shares = "股" in t or "share" in t
    usd = bool(re.search(r"美|u\.?s\.?(?:\$|d(?!\w)|dollar)|usd", t))
    money = usd or bool(re.search(r"元|nt\$|ntd|twd|dollar|台幣", t))
    rest = re.sub(r"new|taiwan|台幣|新台幣|新|美金|美元|美|us\$|usd(?!ollar)|u\.?s\.?(?=dollar)|nt\$|ntd|twd|dollars?|元|股|shares?|of|in|單位|:", "", t)
    rest = re.sub(r"s$", "", rest)
    for name, scale in MAGNITUDES:
        if rest == name:
            break
    else:
        if rest:
            return None
        scale = 1
    if not (shares or money or rest):
        return None
    return Unit(SHARES if shares else MONEY if money else None, scale, "USD" if usd else "TWD" if money else None)


_EXCEPT = [
    (SHARES, re.compile(rf"[,;]?惟股數[為以]({_ZH})(?:計|列示|表達)?|除股數以({_ZH})(?:計|列示|表達)?外[,;]?|[,;]? ?(?:except|other than)(?: for)? share (?:counts?|numbers?|data)(?: in ({_EN}))?")),
    (PER_SHARE, re.compile(rf"[,;]?惟每股(?:盈餘|金額|資料)?[為以]({_ZH})(?:計|列示|表達)?|除每股(?:盈餘|金額|資料)?以({_ZH})(?:計|列示|表達)?外[,;]?|\(?每股(?:盈餘|金額)為({_ZH})\)?|[,;]? ?(?:except|other than)(?: for)? (?:per[ -]share amounts?|earnings per share)(?: in ({_EN}))?")),
]
_STATES = re.compile(rf"單位[:為,，]?\s*({_ZH})(?![^,;。)(\s])|以({_ZH})(?:列示|表達|為單位|計)|^\(?(?:[a-z ]*\b)?in ({_EN})\b")


@lru_cache(65536)
def parse_note(text: str | None) -> tuple[Unit | None, dict[str, Unit]]:
    """The unit that a note states, and those it states for single kinds; amounts that it only mentions are no unit."""
    t = re.sub(r"\s+", " ", fold(text))
    excepted: dict[str, Unit] = {}
    for kind, pattern in _EXCEPT:
        if m := pattern.search(t):
            named = next((g for g in m.groups() if g), None)
            unit = parse_unit(named) if named else Unit(MONEY, 1, None)
            if unit and (named or kind == PER_SHARE):
                excepted[kind] = unit
            t = t[: m.start()] + t[m.end() :]
    m = _STATES.search(t)
    return (parse_unit(next(g for g in m.groups() if g)) if m else None), excepted


_LABEL = re.compile(r"^(.*?)\s*[(（]([^()（）]*)[)）]\s*$")


@lru_cache(65536)
def parse_account(label: str | None, statement: str | None) -> tuple[str, str, Unit | None]:
    """The account of a label without its unit, its kind, and the unit in the label."""
    t, unit = unicodedata.normalize("NFKC", label or "").strip(), None
    if (m := _LABEL.match(t)) and (found := parse_unit(m[2])):
        t, unit = m[1], found
    if "每股" in t or "per share" in t.lower():
        kind = PER_SHARE
    elif statement == "ratio" or re.search(r"[率比]$|比率|週轉|周轉|天數|倍數|ratio|margin", t.lower()):
        kind = RATIO
    elif "股數" in t or re.search(r"\bshares\b", t.lower()):
        kind = SHARES
    else:
        kind = MONEY
    return t, kind, unit


@lru_cache(262144)
def recorded(label: str | None, statement: str | None, unit: str | None, note: str | None) -> tuple[str, str, int | None, str | None, str | None]:
    """Account, kind, scale, currency and source of a figure's recorded unit.

    A note's exception for the figure's own kind goes before the unit field, that before the note's unit, that before the
    label's.  source: exception, unit, note, label; ``other_kind`` where what is recorded measures another kind;
    ``unreadable`` where the unit field is no unit; None where nothing is recorded.
    """
    account, kind, in_label = parse_account(label, statement)
    stated, excepted = parse_note(note)
    of_field, filled = parse_unit(unit), bool(fold(unit))
    for source, u in (("exception", excepted.get(kind)), ("unit", of_field), ("note", None if filled else stated), ("label", None if filled else in_label)):
        if u:
            fits = u.kind in (None, kind) or (kind == PER_SHARE and u.kind == MONEY)
            return (account, kind, u.scale, u.currency, source) if fits else (account, kind, None, None, "other_kind")
    return account, kind, None, None, "unreadable" if filled else None
