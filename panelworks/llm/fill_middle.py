"""Fill-in-the-middle documents by piece tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Where the pieces mark, prefix, mark, suffix, mark, middle (0 to 5) stand in each form.
ORDERS = {"psm": (0, 1, 2, 3, 4, 5), "spm": (2, 3, 0, 1, 4, 5)}


@dataclass
class PieceTable:
    """A document as descriptors (buffer, start, length) over immutable buffers; no text is moved before it is read."""

    buffers: tuple[memoryview, ...]
    pieces: list[tuple[int, int, int]]

    @classmethod
    def of(cls, text: memoryview, marks: memoryview) -> PieceTable:
        return cls((text, marks), [(0, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the descriptor that holds byte ``at`` of the document, counted over all pieces (empty parts stay)."""
        for i, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[i : i + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length
        raise ValueError("beyond the end")

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def parts(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def digest(self) -> str:
        h = sha256()
        for part in self.parts():
            h.update(part)
        return h.hexdigest()

    def read(self) -> bytes:
        return b"".join(self.parts())


def line_ends(text: memoryview) -> np.ndarray:
    """Byte offsets at which the lines of a text end, its own end included if text follows the last newline."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(text) == 0 or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def characters(text: memoryview) -> int:
    """Code points of a UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


@dataclass(frozen=True)
class Plan:
    """Of 100 documents, ``percent`` are rearranged, and of 100 such, ``suffix_first`` in the form spm."""

    seed: int = 7
    percent: int = 100
    suffix_first: int = 50
    marks: tuple[str, str, str] = MARKS

    def draw(self, doc_id: object) -> list[int]:
        """Four numbers of 32 bits that depend on the seed and the doc_id (null: an empty string) alone."""
        digits = sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: memoryview, doc_id: object, plan: Plan) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Number of lines, form, code points of prefix and middle (None if plain), and the arranged document."""
    h1, h2, h3, h4 = plan.draw(doc_id)
    ends, marks = line_ends(text), [m.encode() for m in plan.marks]
    n, whole = len(ends), bytes(text)
    table = PieceTable.of(text, memoryview(b"".join(marks)))
    if not n or h3 % 100 >= plan.percent or any(m in whole for m in marks):
        return n, "plain", None, None, table
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    table.cut(b)
    table.cut(a)
    prefix, middle, suffix = table.pieces
    sizes = [len(m) for m in marks]
    p, s, m = ((1, sum(sizes[:i]), sizes[i]) for i in range(3))
    table.pieces = [p, prefix, s, suffix, m, middle]
    form = "spm" if h4 % 100 < plan.suffix_first else "psm"
    return n, form, characters(text[:a]), characters(text[a:b]), table.arranged(ORDERS[form])


def restored(output: memoryview, form: str, marks: tuple[str, str, str] = MARKS) -> PieceTable:
    """The original document, as descriptors over a document of that form.

    The text holds no sentinel and a sentinel neither begins nor ends within
    another, so the first place of each is its own.
    """
    table = PieceTable.of(output, memoryview(b""))
    if form == "plain":
        return table
    whole, order, at = bytes(output), ORDERS[form], []
    for i in order[::2]:
        mark = marks[i // 2].encode()
        start = whole.index(mark)
        at += [start, start + len(mark)]
    for k in reversed(at[1:]):
        table.cut(k)
    back = table.arranged(tuple(int(i) for i in np.argsort(order)))
    back.pieces = [back.pieces[1], back.pieces[5], back.pieces[3]]
    return back


def _bytes(x: pa.Scalar) -> memoryview:
    return memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output and output_sha256 of every document.

    A text is cut after two drawn lines; the three parts are arranged with
    sentinels, as psm or spm. Empty and null texts (null: empty), texts that hold
    a sentinel and those that the plan leaves alone stay plain, with null
    prefix_chars and middle_chars. Repeated and null doc_ids are rows like others;
    equal rows give equal results. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*made[:4], made[4].read(), made[4].digest()) for i, t in zip(batch.column(0), batch.column(1)) for made in [transform(_bytes(t), i.as_py(), plan)]]
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            made = [pa.array(c, k) for c, k in zip(cols, kinds)]
            made[4] = made[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restore(made: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of :func:`fill_in_middle` with ``text``, the original rebuilt from output and form, and its hash restored_sha256."""
    fields = [f for f in made.schema.fields if f.name not in ("text", "restored_sha256")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, output = batch.column(len(fields)), batch.column(len(fields) + 1)
            back = [restored(_bytes(o), f.as_py(), plan.marks) for f, o in zip(form, output)]
            texts = pa.array([t.read() for t in back], pa.binary()).cast(pa.string())
            hashes = pa.array([t.digest() for t in back], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], texts, hashes], names=[*(f.name for f in fields), "text", "restored_sha256"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    both = made.select(*(f.name for f in fields), F.col("form").alias("_form"), F.col("output").alias("_output"))
    return both.mapInArrow(rows, f"{kinds}, text string, restored_sha256 string")


def fill_in_middle_digests(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    return restore(fill_in_middle(docs, plan), plan).drop("output", "text")
