"""Fill-in-middle: texts are cut into prefix, middle and suffix at token borders and put in another order, behind marks.

A token is white space and what follows up to the next white space; white space at the end
is one of its own.  So a token starts where a text starts and where white space follows
something else: each text becomes an array of code points (UTF-32), neighbouring
classes are compared, and the places where they change this way are its borders.  Two
ranks drawn from a hash of the id name the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import by_bytes

#: The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def token_borders(points: np.ndarray) -> np.ndarray:
    """Where tokens start and the last one ends: 0 up to the length; one entry more than there are tokens.  [0] for an empty text."""
    if not len(points):
        return np.zeros(1, np.int64)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    starts = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.concatenate([[0], starts, [len(points)]])


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits: the first groups of eight hexadecimal digits of the sha256 of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    a, b, c, d = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
    return a, b, c, d


def cut_text(text: str, key: str, seed: int, rate: int, spm_share: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    raw = text.encode("utf-32-le", "surrogatepass")
    borders = token_borders(np.frombuffer(raw, "<u4"))
    n = len(borders) - 1
    a, b, c, d = draws(key, seed)
    if not text or c % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    one, two = int(borders[low]), int(borders[high])
    prefix, middle, suffix = (raw[4 * x : 4 * y].decode("utf-32-le", "surrogatepass") for x, y in ((0, one), (one, two), (two, len(raw) // 4)))
    if d % 100 < spm_share:
        return n, "spm", one, two - one, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", one, two - one, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_share: int = 80) -> DataFrame:
    """One row a document: id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points), output (the text as transformed).

    rate of a hundred texts are cut, of these spm_share of a hundred as suffix, prefix,
    middle, the rest as prefix, suffix, middle.  Texts that hold one of the marks, and empty
    ones, stay plain.  A null text is empty: n 0, plain, an empty output.  The draw depends on
    the id alone; a null id draws as an empty one.  Repeated rows give repeated results, an
    empty table an empty one; columns other than the two named are not read.
    Texts are cut one at a time, so a task holds 2 MB of them, or one that is longer.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, column=2):
            rows = [cut_text(t or "", k, seed, rate, spm_share) for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key")
    return docs.select(id_col, key, text_col).mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before fill_in_middle.  No mark stands in a text that was cut, and none arises where a piece meets a mark, so the marks part the pieces."""
    piece = lambda i: F.element_at(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), i)
    return F.when(form == "psm", F.concat(piece(2), piece(4), piece(3))).when(form == "spm", F.concat(piece(3), piece(4), piece(2))).otherwise(output)
