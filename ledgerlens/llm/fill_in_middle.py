"""Fill-in-middle transformation by one repeated-capture match.

A text is a sequence of units: a word with the white space before it, or the white
space at the end. One fullmatch of ``(unit)*`` keeps every repetition of the group;
``match.ends(1)`` is then the list of all unit ends, so its length is the number of
units and two of its entries are the two cuts. Nothing walks over the units.

Four 32-bit numbers from the sha256 of ``seed:id`` choose the cuts and the form, so
a document is cut alike in every run and however rows are dealt over tasks. With n
units each cut stands after 0 to n of them; the smaller ends the prefix, the larger
the middle. The forms: ``plain``, the text; ``psm``, prefix, suffix and middle each
behind its mark; ``spm``, suffix, prefix and middle. ``restore`` rebuilds the text.

Defined results: a null text is an empty one; an empty text, and one that already
holds a mark, stays plain; a null id hashes as the empty string; rows that repeat an
id are cut at the same unit numbers, each in its own text; a text without words is
one unit; a very long text is matched whole, at some 50 bytes a unit while it is
worked on; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
#: A word with the white space before it, or white space that no word follows.
UNITS = regex.compile(rf"([{SPACE}]*[^{SPACE}]+|[{SPACE}]+)*")
#: Characters of text turned into Python strings at once, and written as one batch.
SLICE_CHARS = 1 << 22
RESULT = "n long, form string, prefix_end long, middle_end long, output string"


@dataclass(frozen=True)
class Rule:
    """Seed of the draws, shares of the forms in percent, and the three marks."""

    seed: int = 42
    plain_percent: int = 50
    spm_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.marks
        if len(set(marks)) < 3 or any(not m or any(m[0] in other[1:] for other in marks) for m in marks):
            raise ValueError("marks must differ, and their first characters must not come again inside a mark")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of ``seed:id``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(text: str | None, h1: int, h2: int, h3: int, h4: int, rule: Rule) -> tuple:
    """(n, form, prefix end, middle end, output) of one text; the ends are code points, null when plain."""
    text = text or ""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not n or h3 % 100 >= rule.plain_percent or any(m in text for m in rule.marks):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[second - 1] if second else 0
    if h4 % 100 < rule.spm_percent:
        return n, "spm", a, b, "".join((rule.suffix, text[b:], rule.prefix, text[:a], rule.middle, text[a:b]))
    return n, "psm", a, b, "".join((rule.prefix, text[:a], rule.suffix, text[b:], rule.middle, text[a:b]))


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_end, middle_end, output) of every row; one pass, no shuffle."""
    ident = docs.schema[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), *draws(id_col, rule.seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["id", "n", "form", "prefix_end", "middle_end", "output"]

        def packed(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=names)

        for batch in batches:
            numbers = [batch.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4)]
            texts, found, chars, first = batch.column("body"), [], 0, 0
            for at in range(batch.num_rows):
                found.append(transform(texts[at].as_py(), *(h[at] for h in numbers), rule))
                chars += len(found[-1][-1])
                if chars >= SLICE_CHARS:
                    yield packed(batch.column("id").slice(first, at + 1 - first), found)
                    found, chars, first = [], 0, at + 1
            if found:
                yield packed(batch.column("id").slice(first, batch.num_rows - first), found)

    out = source.mapInArrow(run, f"id {ident.dataType.simpleString()}, {RESULT}")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that an output and its form stand for, by built-in functions."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in rule.marks), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
             .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def restore(transformed: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The frame of ``fill_in_middle`` with the text rebuilt from ``output`` and ``form``."""
    return transformed.withColumn("restored", restored(F.col("output"), F.col("form"), rule))
