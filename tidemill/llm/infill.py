"""Fill-in-the-middle documents: a text cut at two line ends, its parts marked and put in another order.

The lines are the isolated matches of a Split pre-tokenizer (of the tokenizers library, nothing is
trained). Its offsets are code points; the length of the offset array is the number of lines n, and the
offsets at two ranks, drawn from a digest of the document's id, are the ends of prefix and middle.

Which documents are rearranged and how depends on the id and the seed alone, so a lost task gives the
same rows when it runs again.

Defined cases: a null text is empty; an empty text, and one that holds a mark itself, stays as it is (form
'plain', lengths null); a part may be empty; a null doc_id is drawn as the id '' and passed on as null;
repeated rows give repeated results; doc_id may be of any type that can be cast to a string (whole numbers
are drawn by their decimals); columns beyond doc_id and text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

#: The units that a text is cut into, and the marks before prefix, suffix and middle: fixed values.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percentages: of texts that are rearranged, and of those with the suffix first.
RATE, SPM_RATE = 100, 50


@lru_cache(maxsize=4)
def _splitter(pattern: str) -> Split:
    return Split(Regex(pattern), "isolated")


def ends_of_units(text: str, pattern: str = LINES) -> list[int]:
    """The end of each match, in code points; the matches have to cover the text."""
    return [end for _, (_, end) in _splitter(pattern).pre_tokenize_str(text)] if text else []


def draws(doc_id: str, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits for a document."""
    digest = sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(text: str, doc_id: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, pattern: str = LINES) -> tuple:
    """(n, form, length of prefix, length of middle, output) of one text."""
    ends = ends_of_units(text, pattern)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, pattern: str = LINES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [rearranged(t.as_py(), i.as_py(), seed, rate, spm_rate, pattern) for i, t in zip(b.column(1), b.column(2))]
            n, form, prefix, middle, output = zip(*rows) if rows else [()] * 5
            columns = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), columns[0], pa.array(form, pa.string()), *columns[1:], pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select("doc_id", blank(F.col("doc_id")).alias("drawn"), blank(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form. Marks occur in it only where they were put, as no text that holds one is cut."""
    part = F.split(output, "|".join(MARKS), -1)
    at = lambda k: F.element_at(part, k)
    return (
        F.when(form == "psm", F.concat(at(2), at(4), at(3)))
        .when(form == "spm", F.concat(at(3), at(4), at(2)))
        .otherwise(output)
    )
