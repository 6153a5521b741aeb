"""A second statement of what looks the same, for the SQL that the queries are checked against.

Text is taken apart into characters, and each is looked up in one table from code point to text;
nothing here comes from the operator's own tables, patterns or expressions.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Letters of other alphabets and the Latin letters drawn alike, one beside the other.
LETTERS = (
    ("асԁеһіјӏорԛѕѵԝху", "acdehijlopqsvwxy"), ("АВСЕԌНІЈКМОРԚЅТѴԜХУҮӀ", "ABCEGHIJKMOPQSTVWXYYI"), ("ονρϲϳ", "ovpcj"), ("ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖ", "ABCEHIJKMNOPTXYZ"), ("օՕ", "oO"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"), ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"), ("ɑɡ", "ag"), ("‐‑﹣ʼµへべぺ", "---’μヘベペ"),
)
#: Names of characters that stand for several drawn side by side.
JOINED = ("LATIN SMALL LIGATURE F", "LATIN SMALL LIGATURE LONG S T", "LATIN SMALL LIGATURE ST", "ARMENIAN SMALL LIGATURE MEN", "ARMENIAN SMALL LIGATURE VEW", "ROMAN NUMERAL ", "SMALL ROMAN NUMERAL ", "TWO DOT LEADER", "HORIZONTAL ELLIPSIS", "ONE DOT LEADER", "DOUBLE EXCLAMATION MARK", "DOUBLE QUESTION MARK", "QUESTION EXCLAMATION MARK", "EXCLAMATION QUESTION MARK")
DIGRAPHS = {*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)}
BLANKS = {0x85, 0x2800, *range(9, 14), *range(28, 32)}


@lru_cache
def _letters() -> dict[str, str]:
    return {a: b for there, here in LETTERS for a, b in zip(there, here, strict=True)}


@lru_cache
def _odd() -> list[int]:
    """Code points that may be seen as something else: blanks, controls, marks, letters of the list and characters that stand for others."""
    letters = _letters()
    listed = {ord(x) for c in letters for x in (c, c.lower(), c.upper()) if len(x) == 1} | BLANKS | {ord("ß"), ord("ẞ"), 0x115F, 0x1160, 0x3164, 0xFFA0}
    return [c for c in range(1, 0x110000) if c in listed or unicodedata.decomposition(chr(c)) or unicodedata.category(chr(c)) in ("Cc", "Cf", "Zs", "Zl", "Zp", "Mn")]


@lru_cache
def shown(char: str) -> str:
    """What is seen of one character."""
    code, kind, name = ord(char), unicodedata.category(char), unicodedata.name(char, "")
    if kind[0] == "Z" or code in BLANKS:
        return " "
    if name.startswith("VARIATION SELECTOR") or name.startswith("MONGOLIAN FREE VARIATION") or name == "MONGOLIAN VOWEL SEPARATOR" or "FILLER" in name and "HANGUL" in name or name == "COMBINING GRAPHEME JOINER" or code in (0x17B4, 0x17B5):
        return ""
    signs = name.startswith(("ARABIC NUMBER", "ARABIC SIGN", "ARABIC FOOTNOTE", "ARABIC END OF", "ARABIC DISPUTED", "ARABIC POUND", "ARABIC PIASTRE", "SYRIAC ABBREVIATION", "KAITHI NUMBER"))
    if kind in ("Cc", "Cf") and not signs:
        return ""
    letters = _letters()
    if char in letters:
        return letters[char]
    if name.startswith(("FULLWIDTH ", "HALFWIDTH ")):
        return "".join(letters.get(c, c) for c in (chr(int(x, 16)) for x in unicodedata.decomposition(char).split()[1:]))
    if code in DIGRAPHS or name.startswith(JOINED) and unicodedata.decomposition(char).startswith("<compat>"):
        return "".join(letters.get(c, c) for c in unicodedata.normalize("NFKC", char))
    parts = unicodedata.normalize("NFD", char)
    if len(parts) > 1 and parts[0] in letters:
        return letters[parts[0]] + parts[1:]
    return char


def folded(char: str) -> str:
    """What is seen of one character if letter case is left out."""
    parts = unicodedata.normalize("NFD", char)
    letters = _letters()
    if len(char.lower()) == 1 and parts[0] not in letters and parts[0].upper() in letters and parts[0].isalpha() and len(parts[0].upper()) == 1:
        return unicodedata.normalize("NFC", letters[parts[0].upper()].lower() + parts[1:])
    return "ss" if char in "ßẞ" else shown(char).lower()


@lru_cache
def table(fold: bool) -> str:
    """The SQL table ``m (c, s)`` of characters that are seen as something else."""
    rows = []
    for code in (c for c in _odd() if c >= 128 or not fold):
        seen = folded(chr(code)) if fold else shown(chr(code))
        if seen != (chr(code).lower() if fold else chr(code)):
            rows.append(f"({code}, [{', '.join(str(ord(x)) for x in seen)}])")
    if fold:
        rows += [f"({code}, [{', '.join(str(ord(x)) for x in shown(chr(code)))}])" for code in range(1, 128) if shown(chr(code)) != chr(code)]
    return f"m AS (SELECT chr(c) AS c, array_to_string(list_transform(CAST(s AS INTEGER[]), lambda x : chr(x)), '') AS s FROM (VALUES {', '.join(rows)}) t(c, s))"


def seen(source: str, key: str, fold: bool = False, name: str = "seen") -> str:
    """SQL tables of which the last, ``name`` (key, text, form), has each text of ``source`` with its form, put together character by character."""
    lower = "lower(x.c)" if fold else "x.c"
    return f"""{name}_chars AS (SELECT key, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT {key} AS key, string_split(text, '') AS cs FROM {source} WHERE text IS NOT NULL)),
{name}_said AS (SELECT key, string_agg(coalesce(m.s, {lower}), '' ORDER BY i) AS s FROM {name}_chars x LEFT JOIN m ON m.c = x.c GROUP BY key),
{name} AS (SELECT {key} AS key, text, CASE WHEN text IS NOT NULL THEN trim(regexp_replace(nfc_normalize(coalesce(s, '')), ' +', ' ', 'g')) END AS form FROM {source} LEFT JOIN {name}_said x ON x.key = {key})"""
