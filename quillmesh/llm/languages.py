"""Problem 2: a language and a confidence for every note and every passage.

A multinomial logistic regression on TF-IDF weighted character n-grams of words, sparse by elastic-net
penalties, trained by follow-the-regularised-leader on passages of labelled notes, decides: it has a class for
each language and one for text in none, which learns from names, filler, keystrokes and code. Labels are noisy, so
models of either half drop the passages of the other that contradict theirs, and the rest train the last; its temperature
is calibrated on all held-out passages with the labels they came with. A passage is scored word by word: term
frequencies are relative to the word and then to the passage, so a passage's score is the mean of its words'
scores, which are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._text import by_chars, mix
from quillmesh.llm.residue import LOREM, _repeats

#: Documents of each language in the training sample, and passages taken of them.
SAMPLE, PASSAGES = 400, 1200
#: Characters of each language, about, that the driver gets of that sample; a passage longer than PIECE comes as several.
CHARS, PIECE = 2_000_000, 20_000
#: Words that are scored at once, and bytes of text whose passages are held at once.
BLOCK, SLICE = 200_000, 1_000_000
#: Size of the hashed feature space; with six languages a model has less than 2 MB.
FEATURES = 1 << 16
#: Made-up passages of each kind for the class of no language.
MADE = 400
#: Calibrated probability from which a passage is in a language.
SURE = 0.45
#: A passage of fewer blank-separated words takes the language around it.
WORDS = 6

# The languages and their codes.
CODES = {
    "bg": ("bg", "bul"), "de": ("de", "deu", "ger"), "en": ("en", "eng"), "es": ("es", "spa"), "fr": ("fr", "fra", "fre"), "it": ("it", "ita"),
}
LANGUAGES = sorted(CODES)
NONE = len(LANGUAGES)

_FENCE = re.compile(r"```.*?(?:```|\n\s*\n|\Z)", re.S)
_WRAP = re.compile(r"(?<=[^\W_,;])([,;]?)\r?\n[> \t]*(?=[^\W\d_])")
_LEAD = re.compile(r"(?:[\s>*#•=|]+|[-–—]\s+|\d+[.)]\s+|\[[ xX]\]\s*)+")
_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"://|@|www\.")
_PIECE = re.compile(rf"(?s:.{{1,{PIECE}}})(?!\S)|(?s:.{{1,{PIECE}}})")
_BREAK = re.compile(r"[\r\n]+|(?<=[.!?…])[\"'»”)]*\s+|(?<=[;|])\s*")


def label_language(column):
    """The language that a label names by its ISO 639 code, with or without a region; else null."""
    code = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_][a-z0-9]+)*$", 1)
    named = F.lit(None).cast("string")
    for lang, codes in CODES.items():
        named = F.when(code.isin(*codes), F.lit(lang)).otherwise(named)
    return named


def _join_wrapped(text: str) -> str:
    """Lines that go on in lower case after no end of a sentence are one; no character changes its place."""

    def gap(m: re.Match) -> str:
        return m.group(1) + " " * (len(m.group()) - len(m.group(1))) if text[m.end()].islower() else m.group()

    return _WRAP.sub(gap, text)


def passages(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text outside of code fences."""
    if not text:
        return []
    bare = _FENCE.sub(lambda m: "\n" * len(m.group()), text) if "```" in text else text
    if "\n" in bare:
        bare = _join_wrapped(bare)
    out, at = [], 0
    for m in _BREAK.finditer(bare):
        if m.end() > at:
            out.append((at, m.start()))
            at = m.end()
    out.append((at, len(bare)))
    spans = []
    for a, b in out:
        m = _LEAD.match(bare, a, b)
        a = m.end() if m else a
        while b > a and bare[b - 1].isspace():
            b -= 1
        if b > a:
            spans.append((a, b))
    return spans


#: A word counts as so many n-grams of its own, beside those of its characters.
WHOLE = 4


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (one to four, ends marked) of the words, sorted by word, and the word of each."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    mark = np.zeros(len(code), bool)
    mark[np.cumsum(size) - 1] = mark[np.cumsum(size) - size] = True
    whole = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64)
    ids, of = [np.repeat(whole, WHOLE)], [np.repeat(np.arange(len(words)), WHOLE)]
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 5):
        last = len(code) - n + 1
        h = h[:last] * np.uint64(0x100000001B3) + code[n - 1 : n - 1 + last]
        inside = owner[:last] == owner[n - 1 : n - 1 + last]
        if n == 1:
            inside &= ~mark
        x = mix(h[inside] + np.uint64(n))
        ids.append((x >> np.uint64(20)).astype(np.int64)), of.append(owner[:last][inside])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return np.concatenate(ids)[order] & (FEATURES - 1), of_all[order]


class FTRL:
    """Follow-the-regularised-leader (proximal) for a multinomial logistic regression, by mini-batches."""

    def __init__(self, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.z, self.n = np.zeros((FEATURES, n_classes)), np.zeros((FEATURES, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray) -> None:
        """rows, cols, values: the sparse passages of a batch; y: their classes."""
        used, col = np.unique(cols, return_inverse=True)
        w = self.weights(used)
        scores = np.stack([np.bincount(rows, values * w[col, k], len(y)) for k in range(w.shape[1])], 1)
        p = softmax(scores)
        p[np.arange(len(y)), y] -= 1
        g = np.stack([np.bincount(col, values * p[rows, k], len(used)) for k in range(w.shape[1])], 1)
        sigma = (np.sqrt(self.n[used] + g * g) - np.sqrt(self.n[used])) / self.alpha
        self.z[used] += g - sigma * w
        self.n[used] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def letters(text: str) -> list[str]:
    """Words of letters, lower-cased; web and mail addresses have none."""
    low = text.lower()
    if _MARK.search(low):
        low = " ".join(run for run in low.split() if not _MARK.search(run))
    return [w for w in _TOKEN.findall(low) if w.isalpha()]


class Model:
    """idf-weighted weights of all n-grams for each class, and the calibrated temperature."""

    def __init__(self, weights: np.ndarray, temperature: float):
        self.weights, self.temperature = weights.astype(np.float32), temperature

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """Of each word the mean of the weights of its n-grams, and 1."""
        ids, of = grams(words)
        k = self.weights.shape[1]
        out = np.zeros((len(words), k + 1), np.float32)
        size = np.maximum(1, np.bincount(of, minlength=len(words)))
        for i in range(k):
            out[:, i] = np.bincount(of, self.weights[ids, i], len(words)) / size
        out[:, k] = 1
        return out


def made_up(samples: list[tuple[str, str]], rng: np.random.Generator, n: int = MADE) -> list[list[str]]:
    """Passages in no language: lists of names, made of the sample's capitalised words that occur once, words of filler, keystrokes."""
    seen: dict[str, int] = {}
    for lang, text in samples:
        if lang != "de":
            for w in re.findall(r"(?<=[\w,] )[^\W\d_]+", text):
                if w.istitle():
                    seen[w.lower()] = seen.get(w.lower(), 0) + 1
    names, lorem = sorted(w for w, c in seen.items() if c == 1), sorted(LOREM)
    out = []
    for _ in range(n):
        size = int(rng.integers(WORDS, 12))
        if names:
            out.append([names[i] for i in rng.integers(len(names), size=size)])
        out.append([lorem[i] for i in rng.integers(len(lorem), size=size)])
        out.append(["".join("asdfjklqwer"[i] for i in rng.integers(11, size=int(rng.integers(2, 9)))) for _ in range(size)])
    return out


def _matrix(items: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse passages: row, column and term frequency, sorted by row."""
    ids, of = grams([w for ws in items for w in ws])
    size = np.array([len(ws) for ws in items])
    row = np.repeat(np.arange(len(items)), size)[of]
    return row, ids, 1 / (np.bincount(of)[of] * size[row])


def train(samples: list[tuple[str, str]], code: list[str] = (), seed: int = 7, first: int = 1, epochs: int = 3) -> Model:
    """samples: (language, passage); code: lines in no language. Deterministic for the same samples in the same order."""
    rng = np.random.default_rng(seed)
    by: dict[int, list] = {}
    for lang, text in samples:
        w = letters(text)
        if len(w) >= WORDS:
            by.setdefault(LANGUAGES.index(lang), []).append(w)
    if not by:
        return Model(np.zeros((FEATURES, NONE + 1)), 1.0)
    by[NONE] = made_up(samples, rng) + [w for w in map(letters, code) if w][:PASSAGES]
    picked = []
    for y, ws in sorted(by.items()):
        order = rng.permutation(len(ws))[: PASSAGES if y < NONE else len(ws)]
        picked += [(y, ws[i]) for i in order]
    rng.shuffle(picked)
    y = np.array([p[0] for p in picked])
    rows, cols, tf = _matrix([p[1] for p in picked])
    seen = np.unique(rows * FEATURES + cols) % FEATURES
    df = np.bincount(seen, minlength=FEATURES)
    idf = np.log((1 + len(picked)) / (1 + df)) + 1
    values = tf * idf[cols] * 10
    bounds = np.searchsorted(rows, np.arange(len(picked) + 1))
    held = np.arange(len(picked)) % 5 == 4

    def fit(use: np.ndarray, epochs: int) -> np.ndarray:
        model = FTRL(NONE + 1)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
                at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part])
                model.step(np.repeat(np.arange(len(part)), bounds[part + 1] - bounds[part]), cols[at], values[at], y[part])
        return model.weights()

    def scores(w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(rows, values * w[cols, k], len(picked)) for k in range(w.shape[1])], 1)

    # Each half is judged by a model of the other one, so that no label speaks for itself.
    half = np.arange(len(picked)) // 5 % 2
    agree = np.zeros(len(picked), bool)
    for h in (0, 1):
        agree[half == h] = (scores(fit(np.flatnonzero(half != h), first)).argmax(axis=1) == y)[half == h]
    w = fit(np.flatnonzero(~held & agree), epochs)
    s = scores(w)[held]
    temperatures = 2.0 ** np.arange(-6, 4, 0.25)
    losses = [-np.log(np.maximum(softmax(s / c)[np.arange(held.sum()), y[held]], 1e-9)).mean() for c in temperatures]
    return Model(w * idf[:, None] * 10, float(temperatures[int(np.argmin(losses))]))


class Tagger:
    def __init__(self, model: Model):
        self.model, self.k = model, NONE + 1
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 16, self.k + 1), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        distinct = set(words)
        if len(self.index) + len(distinct) > 600_000:
            self.index.clear()
        if new := [w for w in distinct if w not in self.index]:
            lo = len(self.index)
            self.index.update(zip(new, range(lo, lo + len(new)), strict=True))
            while len(self.index) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[lo : lo + len(new)] = self.model.word_vectors(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def score(self, items: list[list[str]]) -> np.ndarray:
        """Calibrated probabilities of the classes for passages given as words."""
        counts = np.array([len(w) for w in items])
        sums = np.zeros((len(items), self.k + 1))
        has = counts > 0
        if has.any():
            ids = self._ids([w for ws in items for w in ws])  # first: it may put a larger table in place
            vectors = self.table[ids]
            sums[has] = np.add.reduceat(vectors, (np.cumsum(counts) - counts)[has], axis=0)
        return softmax(sums[:, : self.k] / np.maximum(1, sums[:, self.k :]) / self.model.temperature)

    def tag(self, texts: list[str | None]) -> list[list[tuple]]:
        """Of each text its passages: (start, end, words, language or None, confidence)."""
        out: list[list[tuple]] = [[] for _ in texts]
        spans: list[tuple] = []
        items: list[list[str]] = []
        held = 0
        for i, text in enumerate(texts):
            for a, b in passages(text):
                piece = text[a:b]
                w = letters(piece)
                spans.append((i, a, b, len(piece.split()))), items.append(w)
                held += len(w)
                if held >= BLOCK:
                    self._decide(spans, items, out)
                    spans, items, held = [], [], 0
        if items:
            self._decide(spans, items, out)
        return out

    def _decide(self, spans: list[tuple], items: list[list[str]], out: list[list[tuple]]) -> None:
        p = self.score(items)
        best = p.argmax(axis=1)
        for i, (owner, a, b, size) in enumerate(spans):
            w = items[i]
            sure = best[i] != NONE and p[i, best[i]] >= SURE and len(w) > 0 and not (len(set(w)) <= 0.5 * len(w) and _repeats(w))
            out[owner].append((a, b, min(size, len(w)), LANGUAGES[best[i]] if sure else None, float(p[i, best[i]]) if sure else 0.0))


def _shares(counts: dict[str, int], most: int) -> dict[str, float]:
    """Of each language the part that leaves about `most` of its count."""
    return {lang: min(1.0, most / max(1, n)) for lang, n in counts.items()}


def _pieces(text: str) -> Iterator[tuple[int, bool, str]]:
    """(place, whether it is a line of a code fence, text) of what a text gives to the training."""
    for a, b in passages(text):
        for m in _PIECE.finditer(text, a, b):
            yield m.start(), False, m.group()
    for fence in _FENCE.finditer(text):
        for i, line in enumerate(fence.group().splitlines()):
            for m in _PIECE.finditer(line):
                yield fence.start() + i, True, m.group()


def labelled_passages(docs: DataFrame, per_language: int = SAMPLE, most: int = CHARS) -> tuple[list[tuple[str, str]], list[str]]:
    """Passages of about `per_language` documents of each language, and the lines of their code fences.

    Samples by hashes: of the id, and, where the documents of a language have more than `most` characters, of their
    passages. Whole documents are cut where they are; the driver gets about `most` characters, however long they are.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), label_language(F.col("lang")).alias("l"), "body").where(F.col("l").isNotNull() & F.col("body").isNotNull())
    share = F.lit(0.0)
    for lang, part in _shares({r["l"]: r["count"] for r in named.groupBy("l").count().collect()}, per_language).items():
        share = F.when(F.col("l") == lang, F.lit(part)).otherwise(share)
    sample = named.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    parts = _shares({r["l"]: r["n"] for r in sample.groupBy("l").agg(F.sum(F.length("body")).alias("n")).collect()}, most)
    schema = "doc_id long, l string, start long, code boolean, text string"
    types = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_chars(batch, 2, SLICE):
                out = []
                for doc, lang, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    limit = parts[lang] * (1 << 32)
                    out += [(doc, lang, *p) for p in _pieces(text) if xxhash.xxh32_intdigest(f"{doc} {p[0]} {p[2]}") < limit]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "l", "start", "code", "text"])

    # Rows that are repeated whole have the same hash.
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["l"], r["start"], r["text"], r["code"]) for r in sample.mapInArrow(run, schema).distinct().collect())
    return [(r[2], r[4]) for r in rows if not r[5]], [r[4] for r in rows if r[5]]


def document_passages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, part, start, end, n_words, lang, confidence) of every passage of title and body.

    lang is null and the confidence 0 where a passage is in no language: filler, repetitions, keystrokes,
    code, logs, lists of names. Null and empty texts have no passages; whole texts are read.
    """
    model = model or train(*labelled_passages(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, part string, start int, end int, n_words int, lang string, confidence double"
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for batch in batches:
            for piece in (x for some in by_chars(batch, 2, SLICE) for x in by_chars(some, 1, SLICE)):
                ids = piece.column(0).to_pylist()
                out: list[tuple] = []
                for part, column in (("title", 1), ("body", 2)):
                    for doc, spans in zip(ids, tagger.tag(piece.column(column).to_pylist()), strict=True):
                        out += [(doc, part, *span) for span in spans]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "part", "start", "end", "n_words", "lang", "confidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "body").mapInArrow(run, schema)


def document_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence, share, n_languages): the language of most characters of each document.

    Every document with an id comes out once; lang is null where no passage has one. confidence is the mean over the
    language's passages weighted by length, share the part of the classified characters that are in it.
    """
    size = F.col("end") - F.col("start")
    per = document_passages(docs, model).where(F.col("lang").isNotNull()).groupBy("doc_id", "lang").agg(F.sum(size).alias("n"), F.sum(size * F.col("confidence")).alias("c"))
    best = per.groupBy("doc_id").agg(F.max(F.struct("n", "lang", "c")).alias("m"), F.sum("n").alias("all"), F.count("*").cast("int").alias("n_languages"))
    top = best.select("doc_id", F.col("m.lang").alias("lang"), (F.col("m.c") / F.col("m.n")).alias("confidence"), (F.col("m.n") / F.col("all")).alias("share"), "n_languages")
    return docs.select("doc_id").distinct().join(top, "doc_id", "left").fillna(0, ["confidence", "share", "n_languages"])


def unlabelled_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang) of the languages with a passage of WORDS or more words that the document's label doesn't name."""
    found = document_passages(docs, model).where((F.col("n_words") >= WORDS) & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("found")).distinct()
    labels = docs.select("doc_id", label_language(F.col("lang")).alias("named"))
    return found.join(labels, "doc_id").where(~F.col("found").eqNullSafe(F.col("named"))).select("doc_id", F.col("found").alias("lang")).distinct()
