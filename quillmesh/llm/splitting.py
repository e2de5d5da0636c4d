"""Problem 1: pieces of oversized texts, by recursive bisection at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150

#: Boundaries from strong to weak; a cut is made at the end of the match.
BOUNDARIES = [
    re.compile(p)
    for p in (
        r"\n[ \t]*\r?\n(?=[ \t]*(?:#{1,6} |```))",  # before a heading or a code fence
        r"\n[ \t]*\r?\n\s*",  # blank line
        r"\n",  # line
        r"[.!?…。！？]+[\"'»”’)\]]*\s+",  # sentence
        r"[;:,–—]\s+",  # clause
        r"\s+",  # word
    )
]
#: Between these a cut at any character would part what belongs together.
_GLUED = re.compile(r"[̀-ͯ҃-҉‍︀-️]")


def cut_near(text: str, a: int, b: int) -> int:
    """The place in the middle half of [a, b) with the strongest boundary, of equal ones the nearest to the middle."""
    mid, reach = (a + b) // 2, max(1, (b - a) // 4)
    lo, hi = mid - reach, mid + reach
    for boundary in BOUNDARIES:
        ends = [m.end() for m in boundary.finditer(text, lo, hi) if lo < m.end() < b]
        if ends:
            return min(ends, key=lambda e: (abs(e - mid), e))
    while mid + 1 < hi and (_GLUED.match(text, mid) or text[mid - 1 : mid + 1] in ("\r\n", "‍")):
        mid += 1
    return mid


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece; start includes the overlap, which is the end of the piece before.

    A text within the limit is one piece. Else it is cut until no part is longer than limit - overlap,
    then every part but the first is led by the overlap: exactly that many characters, or all there are before it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    most, todo, parts = limit - overlap, [(0, len(text))], []
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            parts.append((a, b))
        else:
            c = cut_near(text, a, b)
            todo += [(c, b), (a, c)]
    return [(a - min(overlap, a), b, min(overlap, a)) for a, b in parts]


def split_documents(docs: DataFrame, body: str = "body", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(doc_id, piece_no, start, end, overlap[, piece]) of every document, in characters.

    A null text has no piece, an empty one a single empty piece; texts within the limit never leave the JVM.
    Every piece has at most `limit` characters; the pieces without their overlaps make up the text again.
    """
    rows = docs.select("doc_id", F.col(body).alias("t")).where(F.col("t").isNotNull())
    schema = "doc_id long, piece_no int, start int, end int, overlap int" + (", piece string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = ["doc_id", "piece_no", "start", "end", "overlap", "piece"]
        n = 6 if with_text else 5
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for i, (a, b, o) in enumerate(pieces(text, limit, overlap)):
                    out.append((doc, i, a, b, o, text[a:b]) if with_text else (doc, i, a, b, o))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names[:n])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names[:n])

    size = F.char_length("t")
    short = rows.where(size <= limit).select(
        F.col("doc_id").cast("long"),
        *(F.lit(0).alias(c) for c in ("piece_no", "start")),
        size.alias("end"),
        F.lit(0).alias("overlap"),
        *([F.col("t").alias("piece")] if with_text else []),
    )
    return short.unionByName(rows.where(size > limit).mapInArrow(run, schema))
