"""Text functions: Catalyst expressions where the semantics allow, Arrow UDFs where they don't."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What makes a question complex wherever it stands in it.
COMPLEX_MARKERS = (
    "compared to", "versus", "vs", "before", "after", "between", "and also", "as well as",
    "last week", "last month", "yesterday", "recently", "both", "difference", "similar", "changed",
)
# Scripts written without blanks, whose runs are cut in pairs of characters.
UNSPACED = (
    (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x309F),
    (0x30A0, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F),
)


def clean_note(text: Column) -> Column:
    """Front matter (at the very start only), code fences, links, URLs, markup and runs of white space removed, in this order."""
    steps = (  # fixed values: what is removed must agree with stored texts
        (r"(?s)\A---\n.*?\n---\n?", ""),
        (r"(?s)```.*?```", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"https?://\S+", " "),
        (r"[#*_>`~]+", " "),
        (r"(?U)\s+", " "),
    )
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def stripped(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cleaned_text(title: Column, body: Column) -> Column:
    """What search sees of a note: title without its type prefix and body, cleaned."""
    return clean_note(stripped(F.concat(strip_type_prefix(F.coalesce(title, F.lit(""))), F.lit(" "), F.coalesce(body, F.lit("")))))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.length(w) > 1)


def stem(word: Column) -> Column:
    """Only ASCII words: the first of -ing, -ed, -es that leaves more than two letters goes, then a final s that isn't ss."""
    n = F.length(word)
    cut = word
    for ending in reversed(("ing", "ed", "es")):
        cut = F.when(word.endswith(ending) & (n > len(ending) + 2), F.substring(word, F.lit(1), n - len(ending))).otherwise(cut)
    m = F.length(cut)
    cut = F.when(cut.endswith("s") & ~cut.endswith("ss") & (m > 3), F.substring(cut, F.lit(1), m - 1)).otherwise(cut)
    return F.when(word.rlike(r"^[\x00-\x7f]*$"), cut).otherwise(word)


def terms(text: Column) -> Column:
    return F.transform(words(text), stem)


def strip_type_prefix(title: Column) -> Column:
    return F.regexp_replace(title, r"(?i)^\s*p\s*[:\-—]\s+", "")


def is_complex(query: Column) -> Column:
    """More than ten words, or one of the markers anywhere in it."""
    low = F.lower(query)
    many = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")) > 10
    for marker in COMPLEX_MARKERS:
        many = many | F.contains(low, F.lit(marker))
    return many


def matches_all(text: Column, keywords: Column) -> Column:
    """Every comma-separated keyword (trimmed, lower-cased, blank ones left out) is part of the text."""
    keys = F.filter(F.transform(F.split(keywords, ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return F.forall(keys, lambda k: F.contains(F.lower(text), k))


def cited_numbers(answer: Column) -> Column:
    """Distinct numbers of [Note #a, #b] marks in order of their first mention."""
    marks = F.regexp_extract_all(answer, F.lit(r"(\[Note #\d+(?:, ?#\d+)*\])"), 1)
    numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"#(\d+)"), 1)))
    return F.array_distinct(F.transform(numbers, lambda x: x.cast("int")))


def strip_invalid_citations(answer: Column, count: Column) -> Column:
    """Single marks whose number is 0 or beyond the context are removed."""
    bad = F.filter(cited_numbers(answer), lambda x: (x < 1) | (x > count))
    return F.aggregate(bad, answer, lambda acc, x: F.replace(acc, F.concat(F.lit("[Note #"), x.cast("string"), F.lit("]")), F.lit("")))


_MARK = r"\[Note\s*#\s*\d+(?:\s*,\s*#\s*\d+)*\]"


def _sentences(answer: Column, least: int = 0) -> Column:
    """Sentences of the lines of an answer in order; lines shorter than `least` are left out, and headings if least > 0."""
    lines = F.filter(F.transform(F.split(answer, r"\n"), lambda l: F.trim(l)), lambda l: (l != "") & (F.length(l) >= least) & (~l.startswith("#") if least else F.lit(True)))
    return F.flatten(F.transform(lines, lambda l: F.split(l, r"(?<=[.!?])\s+")))


def _bare(sentence: Column) -> Column:
    """A sentence without citation marks and leading markup."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(sentence, _MARK, "")), r"^[\s\-*#>]+", ""))


def claims(answer: Column, least: int = 15) -> Column:
    """Claims (text, cited) of an answer: sentences of `least` characters or more, also without their marks, and the first note they cite."""
    found = F.transform(
        F.filter(_sentences(answer, least), lambda p: F.length(F.trim(p)) >= least),
        lambda p: F.struct(_bare(p).alias("text"), F.try_to_number(F.nullif(F.regexp_extract(p, r"\[Note\s*#(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int").alias("cited")),
    )
    return F.filter(found, lambda c: F.length(c["text"]) >= least)


def claim_context(answer: Column, number: Column) -> Column:
    """The sentences whose mark begins with that note number, joined, without marks; null if there are none."""
    pattern = F.concat(F.lit(r"\[Note\s*#\s*"), number.cast("string"), F.lit(r"(?:\s*,\s*#\s*\d+)*\]"))
    return F.nullif(_bare(F.array_join(F.filter(_sentences(answer), lambda p: F.regexp_like(p, pattern)), " ")), F.lit(""))


def split_thinking(message: Column) -> tuple[Column, Column]:
    """(thoughts, answer) of a message with <think>…</think>."""
    return F.trim(F.regexp_extract(message, r"(?s)<think>(.*?)</think>", 1)), F.trim(F.regexp_replace(message, r"(?s)<think>.*?</think>", ""))


def highlight(text: Column, keyword: Column) -> Column:
    """HTML-escaped text with the keyword (a literal) marked, without regard to case."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.when(F.length(keyword) > 0, F.regexp_replace(safe, F.concat(F.lit("(?i)(\\Q"), keyword, F.lit("\\E)")), F.lit("<mark>$1</mark>"))).otherwise(safe)


def percent(score: Column) -> Column:
    return F.concat(F.round(100.0 * score).cast("int").cast("string"), F.lit("%"))


def list_line(text: Column) -> Column:
    """A line of a list without its bullet or number."""
    return F.trim(F.regexp_replace(text, r"^[\s\d.)*-]+", ""))


@lru_cache(1)
def _marks() -> re.Pattern:
    """A letter before U+0530 and the combining marks that follow it."""
    marks = "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c))
    return re.compile(f"((?![{marks}])[\\x00-\\u052f])[{marks}]+")


def normalized(text: str) -> str:
    """Compatibility decomposition, lower case; marks on letters before U+0530 are dropped."""
    return text.lower() if text.isascii() else _marks().sub(r"\1", unicodedata.normalize("NFKD", text).lower())


_ALNUM = re.compile(r"[^\W_]+")
_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_RUN = re.compile(f"[{_UNSPACED}]+|[^{_UNSPACED}]+")
_IS_UNSPACED = re.compile(f"[{_UNSPACED}]")


@lru_cache(500_000)
def _stemmed(word: str) -> str:
    if word.isascii():
        word = next((word[: -len(e)] for e in ("ing", "ed", "es") if word.endswith(e) and len(word) > len(e) + 2), word)
        if len(word) > 3 and word[-1] == "s" and word[-2] != "s":
            return word[:-1]
    return word


def search_terms(text: str | None) -> list[str]:
    """Terms of a text for keyword search: normalised words of two characters or more, stemmed; runs of scripts without
    blanks as pairs of characters (a single one as it is)."""
    return plain_terms(normalized(text)) if text else []


def plain_terms(plain: str) -> list[str]:
    """Terms of a normalised text."""
    if plain.isascii() or not _IS_UNSPACED.search(plain):
        return [_stemmed(w) for w in _ALNUM.findall(plain) if len(w) > 1]
    out = []
    for word in _ALNUM.findall(plain):
        for run in _RUN.findall(word):
            if _IS_UNSPACED.match(run):
                out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
            elif len(run) > 1:
                out.append(_stemmed(run))
    return out


@F.pandas_udf(T.StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else normalized(s))


@F.pandas_udf(T.ArrayType(T.StringType()))
def multilingual_terms(text: pd.Series) -> pd.Series:
    return text.map(search_terms)


@F.pandas_udf(T.StringType())
def blake2(text: pd.Series) -> pd.Series:
    """32 hex digits of BLAKE2s with a 16-byte digest."""
    return text.map(lambda s: None if s is None else hashlib.blake2s(s.encode(), digest_size=16).hexdigest())


def stable_id(source_key: Column, external_id: Column) -> Column:
    return F.concat(source_key, F.lit(":"), F.substring(blake2(external_id), 1, 16))


def content_hash(title: Column, body: Column) -> Column:
    return blake2(F.concat(title, F.lit("\n"), body))


# Fixed value: the object that a model's answer holds.
_TAG_OBJECT = re.compile(r'\{[^{}]*"tag"\s*:\s*"([^"]*)"')


def unwrapped_tag(raw: str) -> str:
    """The tag in a model's answer: what a leading fence holds, the value of "tag" in a JSON object, or the text itself."""
    s = raw.strip()
    if s.startswith("```"):
        s = s.partition("\n")[2].partition("```")[0].strip()
    m = _TAG_OBJECT.search(s)
    return m.group(1) if m else s


_NAME = re.compile(r"[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9\s&/_-]*")


@F.pandas_udf(T.StringType())
def tag_name(raw: pd.Series) -> pd.Series:
    """A model's answer as a tag: unwrapped, punctuation off, at most three words in title case; null if other characters are left."""

    def one(s):
        if s is None:
            return None
        name = " ".join(re.sub(r"['\"{}\[\]:;.,!?]", "", unwrapped_tag(s)).split()[:3]).title()
        return name if _NAME.fullmatch(name) else None

    return raw.map(one)


class JaroTable:
    """Jaro-Winkler similarities of one string with many: shared characters within half the longer length, half the
    number of those out of order (rounded down), and for a similarity above 0.7 a bonus for a common start of up to four."""

    def __init__(self, strings: list[str]):
        self.size = np.array([len(s) for s in strings])
        self.codes = np.zeros((len(strings), max(1, self.size.max(initial=0))), np.uint32)
        for i, s in enumerate(strings):
            self.codes[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters = np.zeros((len(strings), 32), np.int16)
        row, col = np.nonzero(self.codes)
        np.add.at(self.letters, (row, self.codes[row, col] % 32), 1)

    def winkler(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others))
        n, size = int(self.size[i]), self.size[others]
        if not n:
            return np.where(size == 0, 1.0, 0.0)
        # At most so many characters are shared; below 0.7 nothing is added, so these stay under any limit above it.
        most = np.minimum(self.letters[others], self.letters[i]).sum(axis=1)
        maybe = np.flatnonzero((size > 0) & ((most / n + most / np.maximum(size, 1) + 1) / 3 > 0.7))
        if not len(maybe):
            return out
        size, codes = size[maybe], self.codes[others[maybe]]
        codes = codes[:, : size.max()]
        reach = np.maximum(0, np.maximum(size, n) // 2 - 1)
        place = np.arange(codes.shape[1])
        used = np.zeros(codes.shape, bool)
        mine = np.zeros((len(size), n), bool)
        rows = np.arange(len(size))
        for k in range(n):
            fits = (codes == self.codes[i, k]) & ~used & (np.abs(place - k) <= reach[:, None])
            first = fits.argmax(axis=1)
            hit = fits[rows, first]
            used[rows[hit], first[hit]] = True
            mine[:, k] = hit
        m = mine.sum(axis=1)
        order_a, order_b = np.zeros((len(size), n), np.uint32), np.zeros((len(size), n), np.uint32)
        r, c = np.nonzero(mine)
        order_a[r, (mine.cumsum(axis=1) - 1)[r, c]] = self.codes[i, c]
        r, c = np.nonzero(used)
        order_b[r, (used.cumsum(axis=1) - 1)[r, c]] = codes[r, c]
        swaps = (order_a != order_b).sum(axis=1) // 2
        some = np.maximum(m, 1)
        base = np.where(m > 0, (m / n + m / size + (m - swaps) / some) / 3, 0.0)
        head = min(4, n, codes.shape[1])
        same = np.cumprod(codes[:, :head] == self.codes[i, :head], axis=1).sum(axis=1)
        out[maybe] = np.where(base > 0.7, base + same * 0.1 * (1 - base), base)
        return out


def jaro_winkler(a: str, b: str) -> float:
    return float(JaroTable([a, b]).winkler(0, np.array([1]))[0]) if a != b else 1.0
