"""Problem 7: duplicates hidden by formatting differences.

Method: Merkle-style bottom-up hashing.  A record is an ordered node of its
number fields and its text; the text is an ordered node of a preamble, an
unordered node of header lines, and a body; leaves are normalised (white space,
case and punctuation dropped) and digested, the child digests of the header are
sorted, and the root is the digest of what is below it.

Where the lines of a text were run together or wrapped anew, nothing in it shows
where its last header line ends.  So three levels of digests are used, from the
bottom up.  The *flat* digest covers the numbers and the normalised text in its
order; it joins all copies whose header lines stand in one order.  A *sum* over
leaves that no order can change tells which of these classes can be equal to
another at all.  For those only, a text has one root for each place at which
its header may end: every gap between words after the first label, with no
limit on how far down.  Classes with an equal root are one group, and every
different original of a group is compared with its representative, structure
by structure, on the characters.

Labels of header lines are the fixed values below and those learnt from the
table: what stands before a colon in the first block of lines, in at least one
of ``1 / LABEL_SHARE`` of all such lines (so at most LABEL_SHARE of them exist).

Defined cases: null ids or texts take no part; a null number equals an empty
one and ``-``; an empty text is a text like any other; rows with one id count
once per distinct content; of several roots that a class shares with others the
one that most share counts, ties go to the least; an empty input gives empty
results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, code_points, slices
from corpusloom.llm.p05_shared_spans import suffix_hashes
from corpusloom.storage import materialize

#: Labels of header lines and header lines without a value, folded.
HEADER_LABELS = ("mahkemesi", "tarihi", "numarasi", "dava türü", "suç", "tebliğname no", "içtihat metni", "yargitay ilami", "türk milleti adina")
LABEL_SHARE, LABEL_LINES = 1000, 20

_TABLE: list[np.ndarray] = []
_DOT = 0x307  # what is left of a dotted capital, within a word


def _leaf(c: int) -> int:
    """The normalised form of a character, 0 if it is dropped."""
    ch = chr(c)
    kind = unicodedata.category(ch)
    if kind[0] in "ZPC" or kind == "Sk" or c == _DOT:
        return 0
    if ch in "Iİı":
        return ord("i")
    low = ch.lower()
    return ord(low) if len(low) == 1 else c


def _table() -> np.ndarray:
    if not _TABLE:
        t = np.arange(0x110000, dtype=np.uint32)
        t[:0x20000] = [_leaf(c) for c in range(0x20000)]
        _TABLE.append(t)
    return _TABLE[0]


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def normalise(text: str) -> str:
    """Letters, digits and symbols of a text without case; i, ı, İ and I are one letter."""
    out = _table()[code_points(text)]
    return _string(out[out > 0])


def _digest(*parts: bytes) -> bytes:
    """The digest of a node: of the lengths and the values of its children."""
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.digest()


def _leaves(texts: list[str], numbers: list[tuple]) -> tuple[list[bytes], list[bytes]]:
    """(flat digest, order-free digest) of each record."""
    rng = np.random.default_rng(7)
    r1, r2 = (rng.integers(0, 2**64, 0x110000, dtype=np.uint64) for _ in range(2))
    table, flat, loose = _table(), [], []
    for start, end in slices(texts):
        parts = [code_points(t) for t in texts[start:end]]
        codes = table[np.concatenate(parts)]
        kept = codes > 0
        sizes = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]
        codes = codes[kept]
        sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(r[codes])])[sizes]) for r in (r1, r2)]
        data, at = codes.astype("<u4").tobytes(), sizes.tolist()
        for k, row in enumerate(numbers[start:end]):
            fields = [normalise(x or "").encode("utf-8", "surrogatepass") for x in row]
            flat.append(_digest(*fields, data[4 * at[k] : 4 * at[k + 1]]))
            loose.append(_digest(*fields, *(s[k].tobytes() for s in sums), (at[k + 1] - at[k]).to_bytes(8, "little")))
    return flat, loose


def _rows(df: DataFrame, id_col: str, text_col: str, number_cols: list[str]) -> DataFrame:
    """(id, raw, text, n0, n1, ...): raw names the content of a record as it is written."""
    numbers = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"n{i}") for i, c in enumerate(number_cols)]
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), *numbers).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    raw = F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", *(f"n{i}" for i in range(len(number_cols))), "text"), 256)), 1, 16)
    return rows.select("id", raw.alias("raw"), "text", *(f"n{i}" for i in range(len(number_cols))))


def digests(rows: DataFrame) -> DataFrame:
    """(id, raw, flat, loose) of the result of :func:`_rows`."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = list(zip(*(c.to_pylist() for c in batch.columns[3:]))) or [()] * batch.num_rows
        flat, loose = _leaves(batch.column(2).to_pylist(), numbers)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.binary()), pa.array(loose, pa.binary())], names=["id", "raw", "flat", "loose"])

    return arrow_map(rows, per_batch, "id string, raw binary, flat binary, loose binary")


def header_labels(rows: DataFrame) -> list[str]:
    """The labels of header lines, normalised: the fixed ones and those of the table, at most ``LABEL_SHARE`` more."""
    block = F.regexp_extract(F.ltrim("text"), "^(?:[^\\n]*:[^\\n]*\\n)+", 0)  # lines with a colon, from the first line on
    line = rows.select(F.explode(F.split(block, "\\n")).alias("line")).select(F.trim(F.substring_index("line", ":", 1)).alias("label")).where("length(label) between 2 and 40")
    counts = line.groupBy("label").count()
    most = counts.agg(F.sum("count")).first()[0] or 0
    found = counts.where(F.col("count") >= max(LABEL_LINES, most / LABEL_SHARE)).select("label").toLocalIterator()
    return sorted({x for x in (normalise(s) for s in (*HEADER_LABELS, *(r["label"] for r in found))) if x}, key=lambda x: (-len(x), x))


def _shape(text: str, label: re.Pattern) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(normalised codes, where a gap is before one, starts of labels)."""
    codes = code_points(text)
    out = _table()[codes]
    gaps = np.cumsum((out == 0) & (codes != _DOT))[out > 0]
    codes = out[out > 0]
    open_ = np.ones(len(codes) + 1, dtype=bool)
    open_[1:-1] = gaps[1:] != gaps[:-1]
    return codes, open_, [m.start() for m in label.finditer(_string(codes)) if open_[m.start()] and open_[m.start() + len(m.group(1))]]


def _label_pattern(labels: list[str]) -> re.Pattern:
    return re.compile(f"(?=({'|'.join(map(re.escape, labels))}))")


def roots(text: str, loose: bytes, label: re.Pattern) -> list[tuple[int, bytes]]:
    """(end of the header in the normalised text, root digest) for each place at which the header may end."""
    codes, open_, starts = _shape(text, label)
    if not starts:
        return []
    data = codes.astype("<u4").tobytes()
    ends = np.nonzero(open_)[0]
    ends = ends[ends > starts[0]]
    bodies = suffix_hashes(codes)[ends].tolist()
    preamble, closed, k, out = _digest(data[: 4 * starts[0]]), [], 0, []
    for e, body in zip(ends.tolist(), bodies):
        while k + 1 < len(starts) and starts[k + 1] < e:
            closed.append(_digest(data[4 * starts[k] : 4 * starts[k + 1]]))
            k += 1
        header = sorted([*closed, _digest(data[4 * starts[k] : 4 * e])])
        out.append((e, _digest(loose, preamble, *header, body.to_bytes(8, "little"))))
    return out


def structure(text: str, end: int | None, label: re.Pattern) -> tuple:
    """The normalised structure of a text whose header ends at ``end``: preamble, sorted header lines, body."""
    codes, _, starts = _shape(text, label)
    flat = _string(codes)
    if end is None or not starts:
        return (flat,)
    cut = [s for s in starts if s < end] + [end]
    return flat[: starts[0]], sorted(flat[a:b] for a, b in zip(cut, cut[1:])), flat[end:]


def _group_roots(leaves: DataFrame, rows: DataFrame, label: re.Pattern) -> DataFrame:
    """(flat, root, end) of the flat classes that share a root with another."""
    flats = leaves.groupBy("loose", "flat").agg(F.min(F.struct("id", "raw")).alias("one"))
    several = flats.groupBy("loose").count().where("count > 1").select("loose")
    wanted = flats.join(several, "loose", "left_semi").select("flat", "loose", "one.id", "one.raw")
    texts = rows.select("id", "raw", "text").join(wanted, ["id", "raw"]).select("flat", "loose", "text").dropDuplicates(["flat"])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(f, r, e) for f, o, t in zip(*(batch.column(c).to_pylist() for c in range(3))) for e, r in roots(t, o, label)]
        f, r, e = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(r, pa.binary()), pa.array(e, pa.int32())], names=["flat", "root", "end"])

    every = materialize(arrow_map(texts, per_batch, "flat binary, root binary, end int"), "roots")
    shared = every.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    best = every.join(shared, "root").groupBy("flat").agg(F.min(F.struct(-F.col("n"), "root", "end")).alias("best"))
    return best.select("flat", "best.root", "best.end")


def copy_groups(df: DataFrame, id_col: str, text_col: str, number_cols: list[str], block: int = 1000) -> DataFrame:
    """(grp, id): the records of each group of two or more records that differ in formatting only; grp is its least id.

    Digests are aggregated before any text moves; texts move only for different
    originals of groups, each of which meets the representative of its group.
    A group's originals are spread over tasks of about ``block``.
    """
    rows = _rows(df, id_col, text_col, number_cols)
    label = _label_pattern(header_labels(rows))
    leaves = materialize(digests(rows), "leaves")
    linked = materialize(_group_roots(leaves, rows, label), "linked")
    originals = leaves.groupBy("flat", "raw").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).join(linked, "flat", "left")
    originals = materialize(originals.select("flat", "raw", "lo", "hi", F.coalesce("root", "flat").alias("cls"), "end"), "originals")
    groups = originals.groupBy("cls").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.min(F.struct("raw", "lo")).alias("one")).where("lo <> hi")
    groups = materialize(groups.select("cls", "n", F.ceil(F.col("n") / block).cast("int").alias("parts"), F.col("one.raw").alias("first")), "groups")
    inside = originals.join(groups, "cls")
    many = inside.where("n > 1").select("cls", "raw", "end", F.col("lo").alias("id"), "parts", (F.col("raw") == F.col("first")).alias("is_first"))
    held = rows.join(many, ["id", "raw"]).dropDuplicates(["cls", "raw"])
    held = materialize(held, "held")
    fields = [c for c in held.columns if re.fullmatch(r"n\d+", c)]
    sample = held.where("is_first").select("cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("text_1"), F.col("end").alias("end_1"), *(F.col(c).alias(f"{c}_1") for c in fields))
    met = held.withColumn("part", F.pmod(F.xxhash64("raw"), F.col("parts")).cast("int")).join(sample, ["cls", "part"])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        col = {c: batch.column(names.index(c)).to_pylist() for c in names}
        known: dict[bytes, tuple] = {}

        def side(i: int, tail: str) -> tuple:
            return (*(normalise(col[c + tail][i]) for c in fields), *structure(col["text" + tail][i], col["end" + tail][i], label))

        good = []
        for i, c in enumerate(col["cls"]):
            if c not in known:
                known[c] = side(i, "_1")
            good.append(side(i, "") == known[c])
        return pa.RecordBatch.from_arrays([pa.array(col["cls"], pa.binary()), pa.array(col["raw"], pa.binary()), pa.array(good)], names=["cls", "raw", "good"])

    checked = arrow_map(met.select("cls", "raw", "text", "end", *fields, "text_1", "end_1", *(f"{c}_1" for c in fields)), per_batch, "cls binary, raw binary, good boolean")
    alone = checked.where("not good").select("cls", "raw")  # digests that met by chance
    kept = inside.select("cls", "flat", "raw").join(alone, ["cls", "raw"], "left_anti")
    members = materialize(leaves.select("flat", "raw", "id").join(kept, ["flat", "raw"]).select("cls", "id").distinct(), "members")
    names = members.groupBy("cls").agg(F.min("id").alias("grp"), F.max("id").alias("hi")).where("grp <> hi").select("cls", "grp")
    return members.join(names, "cls").select("grp", "id").distinct()


def collapse(df: DataFrame, id_col: str, text_col: str, number_cols: list[str]) -> DataFrame:
    """(id, copies): one record of each group, with the number of its copies (1 where there is no other)."""
    ids = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
    members = ids.join(copy_groups(df, id_col, text_col, number_cols), "id", "left")
    return members.groupBy(F.coalesce("grp", "id").alias("id")).agg(F.count("*").alias("copies"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b): the pairs within groups, the smaller id first."""
    a, b = groups.select("grp", F.col("id").alias("id_a")), groups.select("grp", F.col("id").alias("id_b"))
    return a.join(b, "grp").where("id_a < id_b").select("id_a", "id_b").distinct()
