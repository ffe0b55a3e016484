"""Fill-in-middle transformation by a scan for sparse events.

One automaton over ASCII patterns finds all that matters in a text: the characters at which the class of the text
changes, which end units, and the sentinels. Between two events lies a gap of one class, and the number of units in a
gap follows from its length alone, so the few events are enough to say where the unit of any rank ends: no list of
units is made. The cuts of a document are two ranks, drawn from a hash of its id.

Units are lines (`[^\\n]*\\n|[^\\n]+`), words (`[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`) or code points.

Defined results: a null text is an empty text; an empty text and one that holds a sentinel stay as they are (form
`plain`), as do those that the rate leaves out; a null doc_id is hashed as the empty string; equal ids are cut at equal
draws; repeated rows give a row each; an empty table gives an empty result; other columns, whatever their names, are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle, and the characters that end a class, by unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CLASS_ENDS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Events:
    """One automaton over the class-changing characters of a kind of unit and the sentinels."""

    def __init__(self, unit: str):
        self.unit = unit
        self.automaton = ahocorasick.Automaton()
        for pattern in [*CLASS_ENDS[unit], PREFIX, SUFFIX, MIDDLE]:
            self.automaton.add_word(pattern, pattern)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[list[int], list[tuple[int, str]]]:
        """(places of class-changing characters, (end, sentinel) of the sentinels)."""
        marks, sentinels = [], []
        for at, found in self.automaton.iter(text):
            if len(found) == 1:
                marks.append(at)
            else:
                sentinels.append((at + 1, found))
        return marks, sentinels


class Units:
    """Ranks of a text's units: gaps between events, with the number of units up to each."""

    def __init__(self, unit: str, length: int, marks: list[int]):
        self.unit, self.length = unit, length
        if unit == "char":  # one gap, as many units as characters
            self.n = length
        elif unit == "line":  # each mark ends a unit; a last gap without a mark is one more
            self.ends = marks
            self.n = len(marks) + (length > (marks[-1] + 1 if marks else 0))
        else:  # a gap of other characters is one unit, whose end is the next mark
            self.ends = [b for a, b in zip([-1, *marks], [*marks, length]) if b - a > 1]
            self.n = len(self.ends) + (length > (self.ends[-1] if self.ends else 0))

    def end(self, rank: int) -> int:
        """Where the first `rank` units end."""
        if rank <= 0:
            return 0
        if rank >= self.n:
            return self.length
        if self.unit == "char":
            return rank
        return self.ends[rank - 1] + (self.unit == "line")

    def rank(self, at: int) -> int:
        """How many whole units end at or before a place."""
        if self.unit == "char":
            return min(at, self.n)
        if at >= self.length:
            return self.n
        return bisect.bisect_right(self.ends, at - (self.unit == "line"))


@dataclass(frozen=True)
class Plan:
    """How documents are cut: seed, unit, percentage that is transformed, percentage of those in the form spm."""

    seed: int = 7
    unit: str = "line"
    rate: int = 100
    spm_rate: int = 50


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, doc_id: int | None, plan: Plan, events: Events) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix and of the middle, output)."""
    marks, sentinels = events.scan(text)
    units = Units(plan.unit, len(text), marks)
    h1, h2, h3, h4 = draws(plan.seed, doc_id)
    if not text or sentinels or h3 % 100 >= plan.rate:
        return units.n, PLAIN, None, None, text
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.end(a), units.end(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.spm_rate:
        return units.n, SPM, a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return units.n, PSM, a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: str, form: str, events: Events) -> str:
    """The text that transform() was given, from its output and form alone."""
    if form == PLAIN:
        return output
    sentinels = events.scan(output)[1]
    if [s for _, s in sentinels] != ([SUFFIX, PREFIX, MIDDLE] if form == SPM else [PREFIX, SUFFIX, MIDDLE]):
        raise ValueError("not an output of this form")
    ends = [end for end, _ in sentinels]
    first, second, middle = output[ends[0] : ends[1] - 3], output[ends[1] : ends[2] - 3], output[ends[2] :]
    return second + middle + first if form == SPM else first + middle + second


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
#: Characters of texts in one batch of results.
BATCH_CHARS = 8_000_000


def transformed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    events, rows, size = Events(plan.unit), [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows.append((doc_id, *transform(text.as_py() or "", doc_id, plan, events)))
            size += len(rows[-1][-1])
            if size > BATCH_CHARS:
                yield batch_of(rows)
                rows, size = [], 0
    if rows:
        yield batch_of(rows)


def restored(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    events = Events(plan.unit)
    for batch in batches:
        forms, outputs = batch.column("form").to_pylist(), batch.column("output")
        texts = pa.array([restore(output.as_py(), form, events) for form, output in zip(forms, outputs, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output (text) of every document: a map, no shuffle."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(functools.partial(transformed, plan=plan), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def with_restored(outputs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Rows with form and output, and the text that they were made of as `restored`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema) + ", restored string"
    return outputs.mapInArrow(functools.partial(restored, plan=plan), schema)


def digests(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The transformation of every document with digests of its output and of the text rebuilt from it."""
    sha = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return with_restored(fill_in_middle(docs, plan), plan).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)
