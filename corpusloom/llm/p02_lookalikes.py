"""Problem 2: visually identical text with different characters.

Method: confusables skeleton.  A text is decomposed, every character is
replaced by its prototype from a look-alike table, and decomposed again; texts
with equal skeletons are one group.  The consistent form is the composed
skeleton.  The table is made from the character database: wide, narrow, font,
circled and squared forms, ligatures and Roman numerals by their decompositions,
small capitals, script and enclosed letters and the Latin-shaped letters of
Lisu by their names; what names do not tell (Cyrillic, Greek, Armenian, Coptic,
Cherokee, a few Latin variants) stands in the tables below.  A letter of another script is replaced only in a word that mixes it
with Latin letters, or whose letters all look Latin; other words of that
script are really written in it and stay.

Defined cases: null texts stay null and are no cases; an empty text is its own
form; texts that differ in letter case keep differing, as do dotted and
dotless i, which Turkish tells apart; repeated rows give repeated results; an
empty input gives empty results; the other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import add_columns

#: Letters of other scripts that look like a Latin one, and those that pass for one inside a Latin word.
ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜаеіјорсухѕһԁԛԝӏү" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν" + "ԱՍՏՕօսզհոց",
        "ABESIJKMHOPCTYXYGQWaeijopcyxshdqwly" + "ABEZHIKMNOPTYXocjv" + "UUSOouqhng",
    )
)
INSIDE = dict(zip("вкмнптгиь" + "αβγειηκμπρστυωχ" + "ЛПИ" + "ΔΛΣΩ", "bkmhntrub" + "abyeinkunpotuwx" + "LNN" + "ALEO"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᏒᎩ", "ABCDEGHiJKLMPSTVWZRy"))
COPTIC = dict(zip("ⲀⲂⲈⲌⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲁⲟⲣⲥⲭⲩ", "ABEZHIKMNOPCTYXaopcxy"))
#: Variants of Latin letters whose decompositions do not name the letter.
VARIANTS = dict(zip("ɑɡɩɪʏꞬꬰꭓ", "agiiyGax"))
_STYLES = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>")
_NAMED = re.compile(r"(?:LATIN LETTER SMALL CAPITAL|(?:NEGATIVE )?(?:CIRCLED|SQUARED) LATIN (CAPITAL) LETTER|LATIN SMALL LETTER SCRIPT) ([A-Z])")
_LISU = {f"LISU LETTER {x}A": x for x in "BPDTGKJCZNLSRMVHFWXY"} | {f"LISU LETTER {x}": x for x in "AEIOU"}
LISU = {c: _LISU[name] for c in map(chr, range(0xA4D0, 0xA500)) if (name := unicodedata.name(c, "")) in _LISU}
ALIKE |= CHEROKEE | COPTIC | LISU
#: Characters that may be out of place; all other texts are in the consistent form already.
SUSPECT = "[\\u00A0\\u00AD\\u017F\\u0250-\\u02AF\\u0300-\\u058F\\u061C\\u115F\\u1160\\u13A0-\\u13FF\\u1680\\u17B4\\u17B5\\u180B-\\u180E\\u1AB0-\\u1AFF\\u1C80-\\u1C8F\\u1D00-\\u1DFF\\u1F00-\\u200F\\u2028-\\u202F\\u205F-\\u206F\\u20D0-\\u20FF\\u2100-\\u214F\\u2160-\\u217F\\u2460-\\u24FF\\u2C80-\\u2CFF\\u2DE0-\\u2DFF\\u3000\\u3164\\uA4D0-\\uA4FF\\uA640-\\uA69F\\uA7AC\\uAB30\\uAB53\\uFB00-\\uFB06\\uFE00-\\uFE0F\\uFE20-\\uFE2F\\uFEFF\\uFF01-\\uFFEF"
SUSPECT_JAVA = SUSPECT + "\\x{1D400}-\\x{1D7FF}\\x{1F100}-\\x{1F1FF}\\x{E0000}-\\x{E0FFF}]"
SUSPECT_PYTHON = SUSPECT + "\\U0001D400-\\U0001D7FF\\U0001F100-\\U0001F1FF\\U000E0000-\\U000E0FFF]"

_suspect = re.compile(SUSPECT_PYTHON)
_other = re.compile("[Ͱ-֏Ꭰ-Ᏽᲀ-᲏ἀ-῿Ⲁ-⳿ⷠ-ⷿꓐ-꓿Ꙁ-ꚟ]")
_word = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036F])*")
_blank = {0x115F, 0x1160, 0x3164, 0x34F, 0x17B4, 0x17B5}
_memo: dict[str, str] = {}


def _prototype(ch: str) -> str:
    """What a single character stands for, whatever its neighbours."""
    if ch not in _memo:
        kind, c = unicodedata.category(ch), ord(ch)
        d = unicodedata.decomposition(ch).split()
        named = _NAMED.fullmatch(unicodedata.name(ch, ""))
        if kind == "Zs":
            out = " "
        elif kind == "Cf" or c in _blank or 0xFE00 <= c <= 0xFE0F or 0x180B <= c <= 0x180D:
            out = ""
        elif d and (d[0] in _STYLES or 0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F or c == 0x17F):
            out = "".join(chr(int(x, 16)) for x in d[1:])
        elif named:
            out = named.group(2) if named.group(1) else named.group(2).lower()
        else:
            out = VARIANTS.get(ch, ch)
        _memo[ch] = out
    return _memo[ch]


def _is_other(ch: str) -> bool:
    return bool(_other.match(ch))


def _replace_word(m: re.Match) -> str:
    word = m.group()
    if not _other.search(word):
        return word
    # accents that a look-alike carries are kept: the base letter decides
    bases = unicodedata.normalize("NFD", word)
    others = [c for c in bases if _is_other(c)]
    if any(unicodedata.category(c)[0] == "L" and not _is_other(c) for c in bases):
        return "".join(ALIKE.get(c) or INSIDE.get(c) or c for c in bases)
    return "".join(ALIKE[c] if _is_other(c) else c for c in bases) if all(c in ALIKE for c in others) else word


def skeleton(text: str) -> str:
    """The skeleton of a text: equal for texts that look equal."""
    if _suspect.search(text):
        text = _suspect.sub(lambda m: _prototype(m.group()), unicodedata.normalize("NFD", text))
        if _other.search(text):
            text = _word.sub(_replace_word, text)
    return unicodedata.normalize("NFD", text)


def unify(text: str) -> str:
    """The one consistent form of a text: its skeleton, composed."""
    if not _suspect.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", skeleton(text))


def consistent_form(df: DataFrame, text_col: str, out_col: str = "unified", only_suspects: bool = False) -> DataFrame:
    """``df`` with the consistent form of a text column.

    With ``only_suspects`` the rows whose text holds none of the suspect
    characters are left out: their form is the text itself.
    """
    if only_suspects:
        df = df.where(F.col(text_col).rlike(SUSPECT_JAVA))
    return add_columns(df, text_col, [T.StructField(out_col, T.StringType())], lambda texts: [pa.array([None if t is None else unify(t) for t in texts], pa.string())])


def cases(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kayit): records whose text is not in the consistent form."""
    rows = consistent_form(df.select(F.col(id_col).cast("string").alias("kayit"), F.col(text_col).alias("text")), "text", only_suspects=True)
    return rows.where("unified <> text and kayit is not null").select("kayit").distinct()


def look_alike_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(grp, records, forms): texts that look equal, as groups named by their least record, with the number of records and of different originals.

    Groups are aggregated from digests, with partial sums before the shuffle.
    """
    rows = consistent_form(df.select(F.col(id_col).cast("string").alias("kayit"), F.col(text_col).alias("text")).where("text is not null and kayit is not null"), "text")
    digests = rows.select("kayit", F.sha2("unified", 256).alias("skeleton"), F.xxhash64("text").alias("original")).groupBy("skeleton", "original").agg(F.min("kayit").alias("grp"), F.count("*").alias("records"))
    return digests.groupBy("skeleton").agg(F.min("grp").alias("grp"), F.sum("records").alias("records"), F.count("*").alias("forms")).select("grp", "records", "forms")
