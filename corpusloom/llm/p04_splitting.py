"""Problem 4: splitting oversized items at natural boundaries.

Method: agglomerative merging.  A text is taken apart at all paragraph, line
and sentence ends, and at word ends where a sentence is too long.  Adjacent
segments stand in a heap, the weakest boundary first and the shorter pair
first; a pair is merged while its size plus the overlap fits the limit.  Each
piece but the first then reaches back over up to ``overlap`` characters, to the
start of a word.

Defined cases: a null text has no pieces, nor has one of white space only; a
text within the limit is one piece as it is; white space between pieces
belongs to none; a run without white space that exceeds the limit is cut hard,
a run that just fits keeps whole and has less overlap; repeated rows give
repeated results; an empty input gives an empty result; other columns pass
through, one with the name of the result is replaced.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import add_columns

HARD, WORD, SENTENCE, PARAGRAPH, END = range(5)
KINDS = ("hard", "word", "sentence", "paragraph", "end")
#: A blank line; a line end; a sentence end that is no ordinal, initial or short abbreviation.
_CUT = re.compile(r"(\s*\n\s*\n\s*)|(\s*\n\s*)|(?<![0-9])(?<!\b\w)(?<!\b[A-ZÇĞİÖŞÜ][a-zçğıöşü])(?<!\bvb)(?<!\bvs)[.!?…]+[\"”’'»)\]]*(\s+)")
_RUN = re.compile(r"\S+")


def _atoms(text: str, limit: int, room: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and the kind of boundary after each segment; white space at the ends of segments is left out."""
    starts, ends, kinds = [], [], []

    def words(a: int, b: int, kind: int) -> None:
        for m in _RUN.finditer(text, a, b):
            s, e = m.span()
            while e - s > limit:
                starts.append(s)
                ends.append(s + room)
                kinds.append(HARD)
                s += room
            starts.append(s)
            ends.append(e)
            kinds.append(WORD)
        kinds[-1] = kind

    lead = _RUN.search(text)
    if not lead:
        return starts, ends, kinds
    at = lead.start()
    last = len(text.rstrip())
    for m in _CUT.finditer(text, at, last):
        if m.group(1) is not None:
            end, kind = m.start(), PARAGRAPH
        elif m.group(2) is not None:
            end, kind = m.start(), SENTENCE
        else:
            end, kind = m.start(3), SENTENCE
            if "\n" in m.group(3):
                kind = PARAGRAPH if m.group(3).count("\n") > 1 else SENTENCE
        if end > at:
            if end - at > room:
                words(at, end, kind)
            else:
                starts.append(at)
                ends.append(end)
                kinds.append(kind)
        at = m.end()
    if last > at:
        if last - at > room:
            words(at, last, END)
        else:
            starts.append(at)
            ends.append(last)
            kinds.append(END)
    if kinds:
        kinds[-1] = END
    return starts, ends, kinds


def split(text: str, limit: int = 1200, overlap: int = 200) -> list[tuple[int, int, int, int]]:
    """Pieces as (start, end, overlap with the piece before, kind of boundary at the end)."""
    room = limit - overlap
    if len(text) <= limit:
        return [(0, len(text), 0, END)] if text.strip() else []
    starts, ends, kinds = _atoms(text, limit, room)
    n = len(starts)
    if not n:
        return []
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(kinds[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1) if ends[i + 1] - starts[i] <= room]
    heapq.heapify(heap)
    while heap:
        kind, size, i, j = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or ends[j] - starts[i] != size:
            continue
        ends[i], kinds[i], alive[j], k = ends[j], kinds[j], False, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if ends[k] - starts[i] <= room:
                heapq.heappush(heap, (kinds[i], ends[k] - starts[i], i, k))
        h = before[i]
        if h >= 0 and ends[i] - starts[h] <= room:
            heapq.heappush(heap, (kinds[h], ends[i] - starts[h], h, i))
    pieces, i, floor, kinds_before = [], 0, 0, END
    while i < n:
        s, e = starts[i], ends[i]
        back = s
        if pieces:
            back = max(floor, s - min(overlap, limit - (e - s)))
            if back > 0 and not text[back - 1].isspace():  # to the start of a word, unless a long run has none there
                m = re.search(r"\s+", text[back:s])
                back = back + m.end() if m else (back if kinds_before == HARD else s)
            while back < s and text[back].isspace():
                back += 1
            back = min(back, s)
        reach = pieces[-1][1] if pieces else 0
        pieces.append((back, e, max(0, reach - back), kinds[i]))
        floor, kinds_before = s, kinds[i]
        i = after[i]
    return pieces


_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("overlap", T.IntegerType()), T.StructField("boundary", T.StringType())]))


def with_pieces(df: DataFrame, text_col: str, limit: int = 1200, overlap: int = 200, out_col: str = "pieces") -> DataFrame:
    """``df`` with the pieces of a text column as offsets; null where the text is null."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("overlap", pa.int32()), ("boundary", pa.string())])

    def compute(texts: list) -> list[pa.Array]:
        cuts, rows = [0], [[], [], [], []]
        for t in texts:
            for piece in split(t, limit, overlap) if t is not None else ():
                for column, x in zip(rows, piece):
                    column.append(x)
            cuts.append(len(rows[0]))
        missing = np.array([*(t is None for t in texts), False])
        fields = [*(pa.array(c, pa.int32()) for c in rows[:3]), pa.array([KINDS[k] for k in rows[3]], pa.string())]
        return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32(), mask=missing if missing.any() else None), pa.StructArray.from_arrays(fields, fields=list(kind)))]

    return add_columns(df, text_col, [T.StructField(out_col, _PIECES)], compute)


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 1200, overlap: int = 200) -> DataFrame:
    """(kayit, text, pieces) of the texts above the limit; the others never leave the JVM."""
    rows = df.select(F.col(id_col).cast("string").alias("kayit"), F.col(text_col).alias("text")).where(F.col("kayit").isNotNull() & (F.length("text") > limit))
    return with_pieces(rows, "text", limit, overlap)


def exploded(pieces: DataFrame) -> DataFrame:
    """(kayit, seq, start, end, overlap, boundary, piece): a row for each piece of the result of :func:`oversized`."""
    rows = pieces.select("kayit", "text", F.posexplode("pieces").alias("seq", "p"))
    return rows.select("kayit", (F.col("seq") + 1).alias("seq"), "p.start", "p.end", "p.overlap", "p.boundary", F.substr("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("piece"))


def cut_kind(pieces: Column) -> Column:
    """``zorunlu`` where a word had to be cut, else ``dogal``."""
    return F.when(F.exists(pieces, lambda p: p["boundary"] == "hard"), "zorunlu").otherwise("dogal")
