"""Reading of postal addresses into components, in plain Python for use in worker batches.

``read_address`` takes a free-form address (and the column beside it) apart into house or box
number, direction, street words, street type and unit, whatever their order and abbreviation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Street types and the ways each is written.
STREET_TYPES = {
    "ave": "avenue aven avenu ave av",
    "blvd": "boulevard blvd boul bvd",
    "cir": "circle circ cir crcl",
    "ct": "court crt ct",
    "dr": "drive driv drv dr",
    "hwy": "highway hiway hway hwy",
    "ln": "lane la ln",
    "pkwy": "parkway pkway pkwy pky",
    "pl": "place plc pl",
    "rd": "road rd",
    "sq": "square sq",
    "st": "street str st",
    "ter": "terrace terr ter",
    "trl": "trail trl",
    "way": "way wy",
}
#: Directions.
DIRECTIONS = {"n": "north no n", "s": "south so s", "e": "east e", "w": "west w"}
#: Words before a unit.
UNIT_WORDS = frozenset("apt apartment unit ste suite lot sp space rm room # no number flat".split())
#: Other words with one meaning.
WORDS = {"saint": "saint", "ft": "fort", "fort": "fort", "mt": "mount", "mount": "mount"}
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()

_TYPE_OF = {w: k for k, words in STREET_TYPES.items() for w in words.split()}
_DIR_OF = {w: k for k, words in DIRECTIONS.items() for w in words.split()}
_ORDINAL_OF = {f"{i}{'st' if i == 1 else 'nd' if i == 2 else 'rd' if i == 3 else 'th'}": w for i, w in enumerate(ORDINALS, 1)}
_TOKEN = re.compile(r"#|[0-9]+(?:st|nd|rd|th)\b|[0-9]+[a-z]?\b|[^\W\d_]+(?:'[^\W\d_]+)*")
_BOX = re.compile(r"\b(?:p\.?\s*o\.?\s*b(?:ox)?|post\s+office\s+box|pob|box)\b\W*([0-9]+)")
_COUNTY = re.compile(r"\b(?:county|cnty|cty|co)\.?\s*(?:road|rd)\.?\s*([0-9]+)|\bcr\.?\s*([0-9]+)")
_UNIT = re.compile(r"(?:\b(?:apt|apartment|unit|ste|suite|lot|sp|space|rm|room|flat)\b\.?\s*#?|#|\bno\b\.?\s*(?=[0-9a-z]+\b\W*$))\s*([0-9]+[a-z]?|[a-z])\b\.?")
_HOUSE_MARK = re.compile(r",\s*(?:no|nr|number)\b\.?\s*([0-9]+[a-z]?)\b")


@dataclass(frozen=True)
class Address:
    """Components; empty text where one is missing.  ``street`` are the words between
    direction and type; ``place`` is a trailing part that looks like a town."""

    kind: str = ""
    number: str = ""
    direction: str = ""
    street: str = ""
    type: str = ""
    unit: str = ""
    place: str = ""


def squeeze(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _clean_unit(text: str) -> str:
    return text.lstrip("0") or "0" if text.isdigit() else text


def read_address(line: str | None, more: str | None = None) -> Address:
    """The components of ``line`` and of the column beside it.

    A unit may stand before, behind or in the other column.  A number behind the street,
    or behind ``, No.``, is the house number if none stands in front.
    """
    main, side = squeeze(line), squeeze(more)
    if not main and not side:
        return Address()
    unit = ""
    # A side column that holds the street while the first one holds the unit.
    if side:
        if _only_unit(side):
            unit, side = _UNIT.search(side + " ")[1] if _UNIT.search(side) else side, ""
        elif _only_unit(main):
            unit, main, side = _UNIT.search(main)[1], side, ""
        else:
            main, side = f"{main}, {side}" if main else side, ""
    box = _BOX.search(main)
    if box:
        return Address("box", box[1].lstrip("0") or "0", unit=_clean_unit(unit))
    number = ""
    county = _COUNTY.search(main) or _slipped_county(main)
    road = ""
    if county:
        road = next(g for g in county.groups() if g)
        main = main[: county.start()] + " countyroad " + main[county.end() :]
    mark = _HOUSE_MARK.search(main)
    if mark:
        # Behind a street without another number it is the house, else the unit.
        rest = main[: mark.start()] + "," + main[mark.end() :]
        if re.search(r"[0-9]", re.sub(r"\b[0-9](?:st|nd|rd|th)\b", "", _UNIT.sub("", rest))):
            unit = unit or mark[1]
        else:
            number = mark[1]
        main = rest
    if not unit:
        found = _UNIT.search(main)
        if found:
            unit = found[1]
            head = main[: found.start()]
            # "Elm Ter No. 25": north, as a number's mark has a comma or a house number before it.
            north = found[0].startswith("no") and not head.rstrip().endswith(",") and not re.search(r"[0-9]", head) and bool(head.strip())
            main = f"{head} n {unit} {main[found.end() :]}" if north else head + "," + main[found.end() :]
            unit = "" if north else unit
    parts = [p.strip() for p in main.split(",") if re.search(r"\w", p)]
    place = ""
    if len(parts) > 1:
        # The street is the part with its type or county road, else the first; of the others
        # a number alone is the house number and words alone are a town.
        score = lambda p: (any(t in _TYPE_OF or t == "countyroad" for t in _TOKEN.findall(p)), bool(re.search(r"[^\W\d_]{3}", p)))
        at = max(range(len(parts)), key=lambda i: (score(parts[i]), -i))
        for i, p in enumerate(parts):
            if i == at:
                continue
            tokens = _TOKEN.findall(p)
            if len(tokens) == 1 and tokens[0][0].isdigit():
                number = number or tokens[0]
            elif all(not t[0].isdigit() for t in tokens) and i > at:
                place = place or " ".join(tokens)
        main = parts[at]
    elif parts:
        main = parts[0]
    tokens = _TOKEN.findall(main)
    tokens = [_ORDINAL_OF.get(t, t) for t in tokens]
    if not number and tokens and tokens[0][0].isdigit():
        number, tokens = tokens[0], tokens[1:]
    if not number and len(tokens) > 1 and tokens[-1][0].isdigit():
        number, tokens = tokens[-1], tokens[:-1]
    if not number and unit[:1].isdigit():
        number, unit = unit, ""
    number = number.lstrip("0") or number
    if "countyroad" in tokens:
        return Address("street", number, "", f"county road {road.lstrip('0')}", "cr", _clean_unit(unit), place)
    direction = ""
    if len(tokens) > 1 and tokens[0] in _DIR_OF:
        direction, tokens = _DIR_OF[tokens[0]], tokens[1:]
    if len(tokens) > 1 and tokens[-1] in _DIR_OF:
        direction, tokens = direction + _DIR_OF[tokens[-1]], tokens[:-1]
    kind = ""
    if len(tokens) > 1 and tokens[-1] in _TYPE_OF:
        kind, tokens = _TYPE_OF[tokens[-1]], tokens[:-1]
    words = ["saint" if i == 0 and t == "st" and len(tokens) > 1 else WORDS.get(t, t) for i, t in enumerate(tokens)]
    return Address("street" if words else "", number, direction, " ".join(words), kind, _clean_unit(unit), place)


def _slipped_county(text: str) -> re.Match | None:
    """``county road`` with a slip in the first word."""
    for found in re.finditer(r"\b([a-z]{4,8})\s+(?:road|rd)\b\.?\s*([0-9]+)", text):
        if near(found[1], "county"):
            return re.compile(r"[a-z]{4,8}\s+(?:road|rd)\b\.?\s*([0-9]+)").match(text, found.start())
    return None


def _only_unit(text: str) -> bool:
    """Whether a column holds nothing but a unit."""
    found = _UNIT.search(text)
    if found:
        return not re.search(r"\w", text[: found.start()] + text[found.end() :])
    return bool(re.fullmatch(r"\W*(?:[0-9]{1,4}[a-z]?|[a-z])\W*", text))


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours makes a equal b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and len(x) > 1 and x[2:] == y[2:])
