"""Canonical forms of names, birth dates and voter ids, and which of them agree."""

from __future__ import annotations

import re
import unicodedata

#: Particles that belong to the family name behind them.
PARTICLES = frozenset("van von de der den del della di da du la le mac mc san ter ten".split())

#: Dates that stand for a missing one.
STANDIN_DATES = frozenset(("1900-01-01", "1899-12-31", "1901-01-01", "9999-12-31", "0001-01-01"))

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def plain(text: str | None) -> str:
    """Lower-case letters without accents; blanks squeezed, other signs dropped."""
    if not text:
        return ""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^a-z ]+", "", text.replace("-", " ")).split())


def split_name(full: str | None) -> list[tuple[str, str, str]]:
    """Readings (first, middle, last) of a full name, the likelier first.

    With a comma the family name comes first.  Without one both orders are possible.
    """
    if not full:
        return []
    if "," in full:
        last, _, rest = full.partition(",")
        given = plain(rest).split()
        return [(given[0] if given else "", " ".join(given[1:]), plain(last).replace(" ", ""))]
    # A double name is one word, as it is where a comma sets it apart.
    words, out = [w for w in (plain(x).replace(" ", "") for x in full.split()) if w], []
    joined: list[str] = []
    hold = ""
    for w in words:
        if w in PARTICLES and w is not words[-1]:
            hold += w
        else:
            joined.append(hold + w)
            hold = ""
    if len(joined) == 1:
        return [("", "", joined[0])]
    if len(joined) >= 2:
        out.append((joined[0], " ".join(joined[1:-1]), joined[-1]))
        out.append((joined[1], " ".join(joined[2:]), joined[0]))
    return out


def read_date(text: str | None) -> str:
    """A birth date as ``yyyy-mm-dd``, a year alone as ``yyyy``; '' if missing, a stand-in or
    unreadable.  Slashes are month first."""
    t = (text or "").strip().lower()
    for pattern, order in ((r"(\d{4})-(\d{1,2})-(\d{1,2})(?:\D.*)?", "ymd"), (r"(\d{1,2})/(\d{1,2})/(\d{4})", "mdy"), (r"(\d{4})(\d{2})(\d{2})", "ymd"), (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "dmy")):
        m = re.fullmatch(pattern, t)
        if m:
            part = dict(zip(order, map(int, m.groups()), strict=True))
            if 1 <= part["m"] <= 12 and 1 <= part["d"] <= 31:
                day = f"{part['y']:04d}-{part['m']:02d}-{part['d']:02d}"
                return "" if day in STANDIN_DATES else day
            return ""
    m = re.fullmatch(r"(\d{1,2})\s+([a-z]{3})[a-z]*\.?\s+(\d{4})", t)
    if m and m[2] in _MONTHS:
        return f"{int(m[3]):04d}-{_MONTHS[m[2]]:02d}-{int(m[1]):02d}"
    return t if re.fullmatch(r"(?:18|19|20)\d{2}", t) and t != "1900" else ""


def id_core(text: str | None) -> str:
    """Letters and digits of an id, upper case."""
    return re.sub(r"[^0-9A-Z]", "", (text or "").upper())


def county_digits(text: str | None) -> str:
    """Digits of a county id behind its county prefix."""
    core = id_core(text.split("-")[-1] if text and "-" in text else text)
    return re.sub(r"[^0-9]", "", core)
