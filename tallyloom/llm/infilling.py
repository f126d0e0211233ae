"""Fill-in-middle transformation by bit-parallel big integers (operator 12).

A text is a row of units: runs of A-Z and a-z, and every other code point by itself. bytes.translate turns its UTF-8
bytes into masks of letters and of bytes that begin a code point, which become integers with one lane a byte; a shift
and a few boolean operations on them mark where units begin. bit_count gives their number, and halving a mask finds the
n-th mark. Two hashed ranks cut the text into prefix, middle and suffix, which are put in another order between markers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_arrow

#: The markers.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LETTERS = bytes(b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for b in range(256))
#: Bytes that begin a code point and are no letters.
SINGLES = bytes(not LETTERS[b] and b & 0xC0 != 0x80 for b in range(256))
#: Bytes within a code point: all but its first.
WITHIN = bytes(b for b in range(256) if b & 0xC0 == 0x80)


def unit_starts(data: bytes) -> int:
    """An integer whose bit 8 * i is set where a unit begins at byte i."""
    letters = int.from_bytes(data.translate(LETTERS), "little")
    return letters & ~(letters << 8) | int.from_bytes(data.translate(SINGLES), "little")


def nth(marks: int, rank: int, width: int) -> int:
    """The place of the set bit of that rank, from 0, among the lowest width bits: the half that holds it, and so on."""
    base = 0
    while width > 64:
        half = width >> 1
        low = marks & ((1 << half) - 1)
        if (n := low.bit_count()) > rank:
            marks, width = low, half
        else:
            marks, width, rank, base = marks >> half, width - half, rank - n, base + half
    for _ in range(rank):
        marks &= marks - 1
    return base + (marks & -marks).bit_length() - 1


def cut(data: bytes, marks: int, n: int, units: int) -> int:
    """The byte after so many units."""
    return len(data) if units >= n else nth(marks, units, 8 * len(data)) >> 3


def characters(data: bytes) -> int:
    return len(data.translate(None, WITHIN))


def transformed(data: bytes, draws: tuple[int, ...], plain: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix, of the middle, output) of a text by four drawn numbers."""
    marks = unit_starts(data)
    n = marks.bit_count()
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or draws[2] % 100 >= 100 - plain:
        return n, "plain", None, None, data
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    i, j = cut(data, marks, n, a), cut(data, marks, n, b)
    head, middle, tail = data[:i], data[i:j], data[j:]
    if draws[3] % 100 < spm:
        return n, "spm", characters(head), characters(middle), b"".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle))
    return n, "psm", characters(head), characters(middle), b"".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text of an output. No part of a text holds a marker, and none can arise across a seam, so the first counts."""
    if form == "plain":
        return output
    second, third = (output.index(m, 3) for m in ((SUFFIX if form == "psm" else PREFIX), MIDDLE))
    one, two, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    return b"".join((one, middle, two) if form == "psm" else (two, middle, one))


def draws(salt: str, doc_id: object) -> tuple[int, ...]:
    """The first four groups of eight digits of the SHA-256 of the salt, a colon and the id."""
    digits = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", output: str = "output", salt: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """All columns, n, form, prefix_chars, middle_chars and the output; columns of these names are replaced.

    plain: per cent of texts left as they are, spm: of the others, those whose suffix comes first. A null or empty text,
    or one that holds a marker, stays plain (a null one's output is empty); a null id is drawn for as an empty one.
    Every row is worked on by itself: repeated rows give equal outputs, and nothing is shuffled.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", output)
    kept = docs.drop(*(c for c in made if c not in (doc_id, text)))
    if {doc_id, text} & set(made):
        raise ValueError(f"the id and the text must have other names than {made}")
    id_at, text_at = kept.columns.index(doc_id), kept.columns.index(text)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(id_at).to_pylist()
            rows = [transformed(t, draws(salt, i), plain, spm) for i, t in zip(ids, as_bytes(batch.column(text_at)), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns[:-1], columns[-1].cast(pa.string())], [*batch.schema.names, *made])

        return work

    whole = kept.withColumns({"n": F.lit(0).cast("long"), "form": F.lit(""), "prefix_chars": F.lit(None).cast("long"), "middle_chars": F.lit(None).cast("long"), output: F.lit("")})
    return map_arrow(kept, make, whole.schema, text)


def restore(rows: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """All columns and the text that an output was made from; null outputs or forms give null."""
    kept = rows.drop(text)
    out_at, form_at = kept.columns.index(output), kept.columns.index(form)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = zip(batch.column(out_at).cast(pa.binary()).to_pylist(), batch.column(form_at).to_pylist(), strict=True)
            back = pa.array([None if o is None or f is None else restored(o, f) for o, f in pairs], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns, back], [*batch.schema.names, text])

        return work

    return map_arrow(kept, make, kept.withColumn(text, F.lit(None).cast("string")).schema, output)
