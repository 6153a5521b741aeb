"""One consistent form for texts that look the same but have other characters.

Method: DuckDB runs inside each Arrow partition. One embedded SQL expression
removes characters that are not drawn, maps wide, narrow and joined forms and
look-alike letters (translate and replace), composes accents (nfc_normalize) and
reduces blanks (regexp_replace). Letter case, accents, digits and punctuation stay.

The mapping tables are built by rule from Unicode's own data and one short list of
look-alikes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrow import duckdb_session, pieces
from graphloom.runtime import HOT_ROWS, TILE, Workspace, hot_keys, hot_pairs, lookup, salted_join

#: Letters of other alphabets that are drawn like a Latin letter, and that letter.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian
    "օ": "o", "Օ": "O",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Letters of phonetic alphabets
    "ɑ": "a", "ɡ": "g",
}
#: Signs and kana of one shape.
SAME_SHAPE = {"‐": "-", "‑": "-", "﹣": "-", "ʼ": "’", "µ": "μ", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ"}
#: Ranges of joined letters and signs, whose parts are drawn side by side.
JOINED = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026), (0x203C, 0x203C), (0x2047, 0x2049), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
#: RE2 class of blanks.
BLANK = r"[\t-\r\x1C-\x1F\x{85}\p{Z}\x{2800}]"
#: Joiners, fillers and selectors, which are not drawn though they are no format characters.
FILLERS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0))
#: Format characters that are drawn (signs that span digits or letters).
DRAWN_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


def char_class(codes: set[int]) -> str:
    """RE2 class of code points."""
    parts, start = [], None
    for c in sorted(codes):
        start = c if start is None else start
        if c + 1 not in codes:
            parts.append(f"\\x{{{start:X}}}-\\x{{{c:X}}}" if c > start else f"\\x{{{c:X}}}")
            start = None
    return "[" + "".join(parts) + "]"


@lru_cache
def undrawn() -> frozenset[int]:
    """Characters that are not drawn: controls that are no blanks, format characters, fillers."""
    codes = {c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cc", "Cf")} - DRAWN_FORMATS | {*FILLERS}
    return frozenset(codes - {*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85})


@lru_cache
def uncomposed() -> frozenset[int]:
    """Characters at which text may not be in composed form: marks, joining vowels and consonants of Hangul, and characters that stand for others."""
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    return frozenset(jamo | {c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c))[0] == "M" or unicodedata.normalize("NFC", chr(c)) != chr(c))})


@lru_cache
def mappings() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to one, one character to several), by rule."""
    one, many = dict(LOOK_ALIKES) | SAME_SHAPE, {}

    def add(char: str, to: str) -> None:
        to = unicodedata.normalize("NFC", "".join(one.get(x, x) for x in to))
        if char != to:
            (one if len(to) == 1 else many)[char] = to

    # A letter with an accent looks like the Latin letter with that accent.
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in LOOK_ALIKES:
            add(chr(code), parts)
    # Wide and narrow forms, and joined forms.
    for code in range(0x110000):
        kind, _, parts = unicodedata.decomposition(chr(code)).partition(" ")
        if not kind:
            continue
        joined = any(a <= code <= b for a, b in JOINED)
        if kind in ("<wide>", "<narrow>") or kind == "<compat>" and joined:
            plain = "".join(chr(int(x, 16)) for x in parts.split())
            add(chr(code), unicodedata.normalize("NFKC", plain) if joined else plain)
    return one, many


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache
def form_sql(text: str) -> str:
    """DuckDB SQL for the consistent form of ``text``.

    Most texts, of whatever alphabet, hold no character that is changed; one search tells, and only blanks are reduced.
    Joined forms are replaced only in texts that hold one.
    """
    one, many = mappings()
    visible = f"regexp_replace({text}, '{char_class(undrawn())}', '', 'g')"
    mapped = f"translate({visible}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    parted = mapped
    for char, to in many.items():
        parted = f"replace({parted}, {_quoted(char)}, {_quoted(to)})"
    joined = {ord(c) for c in many}
    # An accent set apart meets its letter only once the letter is mapped; then precomposed look-alikes can't be left over.
    full = f"nfc_normalize(CASE WHEN regexp_matches({text}, '{char_class(joined)}') THEN {parted} ELSE {mapped} END)"
    changed = char_class(undrawn() | uncomposed() | {ord(c) for c in one} | joined)
    return f"trim(regexp_replace(CASE WHEN regexp_matches({text}, '{changed}') THEN {full} ELSE {text} END, '{BLANK}+', ' ', 'g'))"


def _forms(sql: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        con = duckdb_session()
        for batch in batches:
            for part in pieces(batch, 1):
                con.register("part", pa.Table.from_batches([part]))
                yield from con.sql(sql).to_arrow_table().to_batches()

    return run


def consistent_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, form``: each text with its consistent form.

    Null gives null; an empty or blank text the empty form; other columns are
    ignored; repeated rows are worked out each for itself; texts of any length are
    taken whole.
    """
    kind, sql = df.schema[id_col].dataType.simpleString(), f"SELECT id, text, {form_sql('text')} AS form FROM part"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_forms(sql), f"id {kind}, text string, form string")


def _members(df: DataFrame, id_col: str, text_col: str, work: Workspace, hot_rows: int) -> tuple[DataFrame, int]:
    """``id, f, t, texts``: every document of a form that has several distinct texts, by digests of form and text, and their number."""
    forms = consistent_form(df, id_col, text_col).where((F.col("form") != "") & F.col("id").isNotNull())
    keyed = work.cut(forms.select("id", F.unhex(F.md5(F.col("form").cast("binary"))).alias("f"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("t")))
    texts = keyed.groupBy("f", "t").agg(F.count("*").alias("n"))
    several = work.cut(texts.groupBy("f").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where(F.col("texts") > 1))
    hot = hot_keys(None, "f", several.agg(F.sum("n")).first()[0] or 0, several.select("f", "n"), hot_rows)
    members = work.cut(lookup(keyed, several.select("f", "texts"), "f", hot))
    return members, members.count()


def look_alike_classes(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``id, class_id, documents, texts``: every document that looks the same as one with another text.

    ``class_id`` is the least id of the class, ``documents`` and ``texts`` the number of its documents and distinct texts. One row for each
    document, however large the class. Null and blank texts are in no class.
    """
    work = Workspace(df.sparkSession, "classes")
    members, n = _members(df, id_col, text_col, work, hot_rows)
    classes = work.cut(members.groupBy("f").agg(F.min("id").alias("class_id"), F.count("*").alias("documents")))
    hot = hot_keys(None, "f", n, classes.select("f", F.col("documents").alias("n")), hot_rows)
    return lookup(members, classes, "f", hot).select("id", "class_id", "documents", "texts")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS, tile: int = TILE) -> DataFrame:
    """``id_a, id_b`` (the smaller first) of documents whose texts differ but have one consistent form.

    Null and blank texts make no pair, and neither do equal texts. The comparison
    runs on digests of the form and of the text (128 and 128 bits). First the
    distinct texts of each form are counted; only forms with two or more distinct
    texts go on, so that mirrored copies of one text, however many, are not met by a
    join. Distinct texts of a form are paired, then the documents that hold them; keys with
    many rows or results are cut into tiles in each of the joins. The pairs that come out are those
    asked for, no others are built (see ``look_alike_classes`` for one row a document).
    """
    work = Workspace(df.sparkSession, "looks")
    members, n = _members(df, id_col, text_col, work, hot_rows)
    distinct = work.cut(members.select("f", "t").distinct())
    large = n > tile
    hot = hot_pairs(distinct, distinct, "f", hot_rows, tile) if large else None
    two = salted_join(distinct.withColumnRenamed("t", "t_a"), distinct.withColumnRenamed("t", "t_b"), "f", hot, "t_a", "t_b")
    two = work.cut(two.where(F.col("t_a") < F.col("t_b")).select("t_a", "t_b"))
    held = members.select(F.col("t").alias("t_a"), F.col("id").alias("x"))
    first = work.cut(salted_join(held, two, "t_a", hot_pairs(held, two, "t_a", hot_rows, tile) if large else None, "x", "t_b").select("t_b", "x"))
    held = members.select(F.col("t").alias("t_b"), F.col("id").alias("y"))
    both = salted_join(held, first, "t_b", hot_pairs(held, first, "t_b", hot_rows, tile) if large else None, "y", "x")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
