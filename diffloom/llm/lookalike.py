"""Visually identical text with different characters, brought to one form.

Each distinct text of the corpus gets a key: compatibility-normalised, case-folded, with mapped white space and letters
of one shape and without default-ignorable characters. Texts of one key are candidates. Because letter case, accents,
raised and circled signs must stay apart here, an exact check on the finer ``form`` follows within each key. Everything
after the keys works on hashes.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata as ud

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diffloom.operators.skew import dictionary_join, hot_keys
from diffloom.session import staged

# Letters and signs of the same shape as a Latin letter or a more common sign.
_SAME_SHAPE = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "р", "q": "ԛ",
    "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "æ": "ӕ", "ə": "ә",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "ΝͶ",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ", "Æ": "Ӕ",
    "μ": "µ", "Γ": "Г", "Π": "П∏", "Φ": "Ф", "Δ": "∆", "Σ": "∑", "к": "κ",
    "-": "‐‑", ":": "∶꞉", "/": "⁄∕", "*": "∗", "|": "∣ǀ", "!": "ǃ", "·": "∙⋅", "’": "ʼ", ";": "\u037e", "~": "∼", ".": "․", ",": "‚", "<": "‹˂", ">": "›˃",
}
_SHAPE = {ord(x): k for k, xs in _SAME_SHAPE.items() for x in xs}
# Compatibility mappings (by their Unicode tag) that leave the look of a character as it is.
_KEPT_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
# Fixed values: <compat> characters that don't look like their mapping: long s, Greek symbol forms, spacing accents
# (mapped to a blank and an accent), enclosed numbers and letters.
_OTHER_LOOK = re.compile("[\u017f\u1e9b\u03d0-\u03d6\u03f0\u03f1\u03f4\u03f5\u00a8\u00af\u00b4\u00b8\u02d8-\u02dd\u2017\u203e\u2474-\u24b5\u3200-\u325f\u3280-\u33ff]")
# The default-ignorable code points of the Unicode character database.
_IGNORABLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
# A joiner between pictographs or letters of joining scripts changes what is seen, so it stays.
_JOINER = re.compile(
    "(?<=[\u0600-\u07ff\u0900-\u0dff])[\u200c\u200d](?=[\u0600-\u07ff\u0900-\u0dff])"
    "|(?<=[\u2190-\u2bff\ufe0f\U0001f000-\U0001faff])\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff])"
)
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_ASCII = re.compile(r"[\x00-\x7f]*")


class _Looks(dict):
    """Code point -> what it looks like, filled as code points are met (at most as many entries as Unicode has)."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        tag, _, rest = ud.decomposition(ch).partition(" ")
        if c in _SHAPE:
            out = _SHAPE[c]
        elif _SPACES.match(ch):
            out = " "
        elif tag in _KEPT_LOOK and not _OTHER_LOOK.match(ch):
            out = "".join(self[int(x, 16)] for x in rest.split())
        else:
            out = ch
        self[c] = out
        return out


_looks = _Looks()


def form(text: str) -> str:
    """The one form of all texts that look like ``text``; case, accents, digits, raised and circled signs stay."""
    if _ASCII.fullmatch(text):
        return text
    spans = [m.start() for m in _JOINER.finditer(text)]
    cuts = [0, *(x for i in spans for x in (i, i + 1)), len(text)]
    keep = "".join(part if k % 2 else _IGNORABLE.sub("", part) for k, part in enumerate(text[x:y] for x, y in zip(cuts, cuts[1:])))
    return ud.normalize("NFC", ud.normalize("NFD", keep).translate(_looks))


_WHITE = re.compile(r"[\t-\r\x1c-\x1f\x85\u2028\u2029]|" + _SPACES.pattern)
_LOWER_ASCII = {**{i: i + 32 for i in range(65, 91)}, **{i: 32 for i in (*range(9, 14), *range(28, 32))}}


def look_key(text: str) -> str:
    """The candidate key: compatibility normalisation, full case folding, white space mapped, ignorables removed.

    Texts of one form have one key, but not the other way round.
    """
    if text.isascii():
        return text.translate(_LOWER_ASCII)
    t = ud.normalize("NFKD", _IGNORABLE.sub("", text).translate(_SHAPE)).translate(_SHAPE)
    t = ud.normalize("NFKD", t.casefold()).translate(_SHAPE).casefold()
    return ud.normalize("NFKC", _IGNORABLE.sub("", _WHITE.sub(" ", t)))


def _digest(t: str) -> bytes:
    return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _looks_of(docs: DataFrame, key: str, text: str, *out: str) -> DataFrame:
    """(key, out..) of every row; out: look (hash), form_hash or form; null for a null text."""
    of = {"look": lambda t: _digest(look_key(t)), "form_hash": lambda t: _digest(form(t)), "form": form}

    def run(batches):
        for b in batches:
            coded = b.column(1).dictionary_encode()
            values = coded.dictionary.to_pylist()
            cols = [pa.array(map(of[o], values), pa.string() if o == "form" else pa.binary()).take(coded.indices) for o in out]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *out])

    kinds = ", ".join(f"{o} {'string' if o == 'form' else 'binary'}" for o in out)
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {kinds}")


def forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form) of every row; null for a null text."""
    return _looks_of(docs, key, text, "form")


def lookalikes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes and membership of non-blank texts that look the same as another one.

    Classes are (class, text_hash): the distinct texts (128-bit hashes) of each class of two or more that have equal keys
    and, by the exact check, equal forms. Members are (text_hash, key): the rows that hold these texts. Keys and forms
    are worked out once per distinct text. Null, empty and blank texts are in no class; repeated rows count once; an
    empty table gives empty results.
    """
    shown = docs.where(F.col(text).rlike(r"(?U)[^\s\u00ad\u200b-\u200f\u2060-\u206f\ufeff]")).select(key, text, F.unhex(F.md5(text)).alias("text_hash"))
    texts = shown.select("text_hash", text).dropDuplicates(["text_hash"])
    looks = staged(_looks_of(texts, "text_hash", text, "look", "form_hash"), "looks")
    alike = looks.groupBy("look").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("look")
    candidates = looks.join(alike, "look", "left_semi")
    same = candidates.groupBy("look", "form_hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("look", "form_hash")
    classes = staged(candidates.join(same, ["look", "form_hash"], "left_semi").select(F.col("form_hash").alias("class"), "text_hash"), "lookalikes")
    return classes, staged(shown.select("text_hash", key).join(classes.select("text_hash"), "text_hash", "left_semi").distinct(), "members")


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of rows whose texts differ in code points but look the same.

    Pairs are made between the distinct texts of a class first and then spread to the rows that hold them; texts that
    many rows hold are spread over many tasks. Copies of one text are never paired with each other.
    """
    classes, members = lookalikes(docs, key, text)
    a, b = classes.withColumnRenamed("text_hash", "text_a"), classes.withColumnRenamed("text_hash", "text_b")
    pairs = a.join(b, "class").where(F.col("text_a") < F.col("text_b")).drop("class")
    often = hot_keys(members.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")), "text_hash", "n", members.count())
    holders = lambda t, k: members.select(F.col("text_hash").alias(t), F.col(key).alias(k))
    left = dictionary_join(holders("text_a", "_x"), pairs, "text_a", "_x", often.select(F.col("text_hash").alias("text_a"))).drop("text_a")
    both = dictionary_join(holders("text_b", "_y"), left, "text_b", "_y", often.select(F.col("text_hash").alias("text_b")))
    return both.where(F.col("_x") != F.col("_y")).select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b")).distinct()
