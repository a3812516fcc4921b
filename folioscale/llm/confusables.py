"""Visually identical text with different characters (problem 7).

Method: confusables skeleton. A text is decomposed, every character is replaced by its prototype
(look-alike letters, digits and marks, compatibility forms, radicals that stand for ideographs; invisible
characters by nothing, odd spaces by a space), and decomposed again; texts that look alike have equal
skeletons, whatever their scripts. Originals are grouped by skeleton.

The form handed out keeps what is rightly written: it is decomposed, replaced and decomposed likewise and
then composed, but a letter of another script is replaced only where it imitates: in a word mixed with Latin
letters, or in a word made of look-alikes only amid Latin words. Words wholly in another script stay as
they are, and so do the usual Chinese punctuation, digits and capital letters, which only the skeleton
takes together with the letters they resemble. Null gives null, empty gives empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Cyrillic, Greek and other letters by the Latin letter they look like. Fixed values.
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "Ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ҽ": "e", "ɡ": "g", "һ": "h", "հ": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "ϳ": "j", "κ": "k", "к": "k", "ⅼ": "l", "ӏ": "l", "ո": "n", "п": "n", "о": "o", "ο": "o", "օ": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ѡ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ү": "y", "ᴢ": "z",
    "А": "A", "Α": "A", "В": "B", "Β": "B", "С": "C", "Ϲ": "C", "Е": "E", "Ε": "E", "Ԍ": "G", "Н": "H", "Η": "H", "І": "I", "Ι": "I", "Ӏ": "I", "Ј": "J", "К": "K", "Κ": "K", "М": "M", "Μ": "M", "Ν": "N", "О": "O", "Ο": "O", "Օ": "O", "Р": "P", "Ρ": "P", "Ԛ": "Q", "Ѕ": "S", "Տ": "S", "Т": "T", "Τ": "T", "Ս": "U", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Χ": "X", "У": "Y", "Υ": "Y", "Ү": "Y", "Ζ": "Z",
}
#: Letters of Cherokee, Lisu and Coptic, by the Latin letter they look like. Fixed values.
FAR_LOOKALIKES = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
}
#: What only the skeleton takes together. Fixed values.
ALIKE = {"0": "O", "1": "l", "I": "l", "|": "l", "∣": "l", "ǀ": "l", "m": "rn", "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‚": "'", "′": "'", "ʼ": "'", "ː": ":", "꞉": ":", "։": ":", "׃": ":", "∶": ":", "⁄": "/", "∕": "/", "․": ".", "‧": "·", "•": "·", "・": "·", "∙": "·", "⋅": "·", "ס": "o", "ه": "o", "ו": "l", "ן": "l", "ا": "l"}
SMALL_CAPITAL = re.compile(r"LATIN LETTER SMALL CAPITAL ([A-Z])")
#: Radicals without a compatibility decomposition, by the ideograph they look like. Fixed values.
RADICALS = dict(zip("⺟⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⻳⺼⻌⻎⻖⻏", "母民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙龟月辶辶阝阝"))
#: Marks that are plainly typed in Chinese though they have compatibility forms, and others usual in text.
USUAL = set("，。！？：；（）【】《》〈〉「」『』、·…—～“”‘’％＆＋－／＝＜＞［］｛｝￥°©®™№")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e0fff]")
#: Values without any of the other characters need no further look.
PLAIN = re.compile("[\t\n\r -~一-鿿" + re.escape("".join(USUAL)) + "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿŒœß«»¿¡]*")
WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


@lru_cache(4096)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


@lru_cache(65536)
def _prototype(c: str) -> str:
    """What the character looks like, look-alike letters aside."""
    if c in USUAL or c.isascii() or "一" <= c <= "鿿":
        return c
    if INVISIBLE.match(c):
        return ""
    if c in RADICALS:
        return RADICALS[c]
    if unicodedata.category(c) == "Zs" or c in "\u2028\u2029\u0085":
        return " "
    return unicodedata.normalize("NFKD", c)


@lru_cache(65536)
def _look(c: str) -> str:
    """What the character looks like, whatever its script: of its prototype's characters each by its own."""
    out = []
    for x in unicodedata.normalize("NFKD", _prototype(c)) if c not in USUAL else _typed(c):
        if x in LOOKALIKES or x in FAR_LOOKALIKES:
            x = LOOKALIKES.get(x) or FAR_LOOKALIKES[x]
        elif not x.isascii():
            if m := SMALL_CAPITAL.fullmatch(unicodedata.name(x, "")):
                x = m[1].lower()
            elif unicodedata.category(x) == "Nd" and unicodedata.decimal(x) == 0 and "ARABIC" not in unicodedata.name(x, ""):
                x = "O"  # the zero of most scripts is a circle
            elif unicodedata.category(x) == "Pd":
                x = "-"
        out.append(ALIKE.get(x, x))
    return "".join(out)


def _typed(c: str) -> str:
    """Chinese punctuation is itself, but full-width forms of ASCII look like it."""
    return unicodedata.normalize("NFKD", c) if "！" <= c <= "～" else c


def skeleton(text: str) -> str:
    """The decomposed prototype text: equal for texts that look alike."""
    return unicodedata.normalize("NFD", "".join(map(_look, unicodedata.normalize("NFD", text))))


def _imitators(word: str, latin_around: bool) -> bool:
    """Does the word, invisible and compatibility forms resolved, imitate Latin letters?"""
    scripts = {_script(c) for c in word if c.isalpha()}
    alike = lambda c: c in LOOKALIKES or c in FAR_LOOKALIKES
    if "LATIN" in scripts:
        return bool(scripts & {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU", "COPTIC"}) or any(map(alike, word))
    return latin_around and all(alike(c) or unicodedata.combining(c) for c in word)


def form(text: str | None) -> str | None:
    """The one consistent form of a text."""
    if text is None or PLAIN.fullmatch(text):
        return text
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(map(_prototype, unicodedata.normalize("NFD", text)))))
    latin = any(_script(c) == "LATIN" for c in text if c.isalpha() and c not in LOOKALIKES)
    text = WORD.sub(lambda m: "".join(LOOKALIKES.get(c) or FAR_LOOKALIKES.get(c, c) for c in m[0]) if _imitators(m[0], latin) else m[0], text)
    return unicodedata.normalize("NFC", text)


def deviates(text: str | None) -> bool:
    """Does it hold a character that only imitates, splits, composes or spaces out?"""
    return text is not None and not PLAIN.fullmatch(text) and form(text) != text


def _marked(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names = [], []
            keys = b.column(0).to_pylist()
            for n, f in enumerate(fields, 1):
                for key, text in zip(keys, b.column(n).to_pylist()):
                    if deviates(text):
                        rows.append(key)
                        names.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(rows, b.schema.field(0).type), pa.array(names, pa.string())], names=["row", "field"])

    return run


def _formed(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([form(t) for t in b.column(n).to_pylist()], pa.string()) for n in range(1, len(fields) + 1))], names=["row", *fields])

    return run


def _narrow(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col(f"`{row}`").cast("bigint").alias("row"), *(F.col(f"`{f}`").cast("string").alias(f"f{n}") for n, f in enumerate(fields)))


def deviations(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """(row, field): the values that differ from what would plainly be typed."""
    return _narrow(df, row, fields).mapInArrow(_marked(fields), "row bigint, field string")


def forms(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """(row, *fields): every value in its one form."""
    return _narrow(df, row, fields).mapInArrow(_formed(fields), ", ".join(["row bigint", *(f"`{f}` string" for f in fields)]))


def lookalike_groups(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """(field, form, n_rows, n_spellings): originals grouped by equal skeleton, under the form of the commonest.

    Spellings are counted per value first, so a value that a third of all rows hold is one row of
    the second grouping.
    """
    long = None
    both = df.select(*(F.col(f"`{f}`").cast("string").alias(f) for f in fields))
    for f in fields:
        one = both.select(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")).where("value is not null")
        long = one if long is None else long.unionByName(one)
    ship(df.sparkSession)
    values = long.groupBy("field", "value").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([skeleton(t) for t in held], pa.string()), pa.array([form(t) for t in held], pa.string()), b.column(2)], names=["field", "skeleton", "form", "n"])

    shaped = values.mapInArrow(run, "field string, skeleton string, form string, n bigint")
    return shaped.groupBy("field", "skeleton").agg(F.max_by("form", F.struct("n", "form")).alias("form"), F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings")).select("field", "form", "n_rows", "n_spellings")
