"""Text functions of columns: tokens, cleaning, case, and what models reply."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Off with white space of any script at both ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """Runs of a-z that stand alone in the lower-cased text."""
    return F.filter(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$"))


def split_words(text: Column | str) -> Column:
    """Split at white space, empty ends dropped."""
    return F.filter(F.split(_col(text), r"\s+"), lambda w: w != "")


def split_words_keeping_empty(text: Column | str) -> Column:
    """Split at white space, empty ends kept."""
    return F.split(_col(text), r"\s+")


def count_words(text: Column | str) -> Column:
    return F.size(split_words(text))


def tokens_with_separators(text: Column | str) -> Column:
    """Words and the white space between them; joined, they are the text."""
    return F.regexp_extract_all(_col(text), F.lit(r"\s+|\S+"), F.lit(0))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def sums_before(lengths: pa.Array) -> pa.Array:
    """For each of an array's whole numbers the sum of those before it; one running sum over all arrays of a batch, so linear in what they hold."""
    offsets = lengths.offsets.to_numpy().astype("int64")
    ends = np.concatenate([[0], np.cumsum(lengths.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], dtype="int64")])
    offsets -= offsets[0]
    before = ends[:-1] - np.repeat(ends[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(before, pa.int32()), mask=lengths.is_null())


#: Word characters: of ASCII, as browsers and Java have them; of all scripts, as Python has them.
_ASCII, _ANY = r"\w", r"\p{L}\p{N}_"


def clean(word: Column | str, unicode: bool = False) -> Column:
    """Word characters only, lower case."""
    return F.lower(F.regexp_replace(_col(word), f"[^{_ANY if unicode else _ASCII}]", ""))


def clean_keeping_apostrophes(word: Column | str) -> Column:
    """Word characters of any script and apostrophes, lower case."""
    return F.lower(F.regexp_replace(_col(word), f"[^{_ANY}']", ""))


def clean_ends(word: Column | str) -> Column:
    """What stands beside word characters and apostrophes goes, at both ends; lower case."""
    return F.lower(F.regexp_replace(_col(word), r"^[^\w']+|[^\w']+$", ""))


def letters_only(word: Column | str, apostrophes: bool = False) -> Column:
    return F.regexp_replace(F.lower(_col(word)), "[^a-z']" if apostrophes else "[^a-z]", "")


def strip_punctuation(word: Column | str) -> Column:
    return F.regexp_replace(_col(word), f"^[^{_ANY}]+|[^{_ANY}]+$", "")


def upper_by_letter(text: Column | str) -> Column:
    """Upper case, a letter for each letter, as SQL has it: the sharp s has a capital of its own, letters without one stay."""
    t = F.translate(_col(text), "ß", "ẞ")
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.when(t.rlike(r"^[\x00-\x7F]*$"), F.upper(t)).otherwise(F.array_join(F.transform(F.split(t, ""), one), ""))


def match_case(original: Column | str, corrected: Column | str, upper: Callable[[Column], Column] = F.upper) -> Column:
    """All upper as the original; or its first letter upper; or as it is."""
    o, c = _col(original), _col(corrected)
    first = F.substring(o, 1, 1)
    return F.when(o == upper(o), upper(c)).when(first == upper(first), F.concat(upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))).otherwise(c)


def preserve_case(original: Column | str, corrected: Column | str) -> Column:
    """All upper or all lower as the original; or as it is."""
    o, c = _col(original), _col(corrected)
    return F.when(o == F.upper(o), F.upper(c)).when(o == F.lower(o), F.lower(c)).otherwise(c)


def strip_reply_prefix(reply: Column | str) -> Column:
    """A model's "Here's the corrected sentence:" and "Corrected:" go."""
    once = F.regexp_replace(_col(reply), r"(?i)^(here'?s?\s+(the\s+)?corrected\s+(sentence|text)[:\s]*)", "")
    return strip(F.regexp_replace(once, r"(?i)^(corrected[:\s]*)", ""))


def strip_thinking(reply: Column | str) -> Column:
    """What follows the last closed think block, or stands before an open one; its first line."""
    r = strip(reply)
    said = F.when(~r.contains("<think>"), r).when(r.contains("</think>"), strip(F.element_at(F.split(r, "</think>"), -1))).otherwise(strip(F.element_at(F.split(r, "<think>"), 1)))
    return strip(F.element_at(F.split(said, "\n"), 1))


def first_word(reply: Column | str) -> Column:
    """First word of the first line, or the empty text."""
    return F.regexp_extract(F.element_at(F.split(strip(reply), "\n"), 1), r"(\S+)", 1)


def parse_changes(reply: Column | str, valid_words: Iterable[str] = ()) -> Column:
    """Array of (original, corrected) from a line "CHANGES: a->b, c->d".

    The first line that holds the marker counts.  Parts with more or fewer than one
    arrow, empty or equal sides (ignoring case) and valid originals are left out.
    """
    r = _col(reply)
    line = F.try_element_at(F.filter(F.split(r, "\n"), lambda x: F.upper(x).contains("CHANGES:")), F.lit(1))
    listed = strip(F.regexp_extract(F.coalesce(line, F.lit("")), r"(?i)CHANGES:\s*(.+)$", 1))
    parts = F.transform(F.filter(F.split(listed, ","), lambda x: F.size(F.split(x, "->")) == 2), lambda x: F.split(x, "->"))
    pairs = F.transform(parts, lambda p: F.struct(strip_punctuation(strip(p[0])).alias("original"), strip_punctuation(strip(p[1])).alias("corrected")))
    ok = lambda p: (p["original"] != "") & (p["corrected"] != "") & (F.lower(p["original"]) != F.lower(p["corrected"]))
    kept = F.filter(pairs, ok)
    valid = sorted(valid_words)
    kept = F.filter(kept, lambda p: ~F.lower(p["original"]).isin(valid)) if valid else kept
    return F.when(F.lower(listed) == "none", F.filter(kept, lambda p: F.lit(False))).otherwise(kept)


def keep_punctuation(word: Column | str, correction: Column | str) -> Column:
    """The correction with all of the word's punctuation behind it."""
    return F.concat(_col(correction), F.regexp_replace(_col(word), f"[{_ANY}]", ""))


def any_case(word: Column) -> Column:
    """A pattern of exactly this text, letter by letter whatever its case: places found by it are those of the text itself, which lower-casing may make longer."""
    return F.concat(F.lit("(?iu)\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def replace_first(text: Column | str, original: Column, corrected: Column) -> Column:
    """The first occurrence, whatever its case, replaced literally."""
    t = _col(text)
    parts = F.split(t, any_case(original), 2)
    return F.when((original != "") & (F.size(parts) == 2), F.concat(F.get(parts, F.lit(0)), corrected, F.get(parts, F.lit(1)))).otherwise(t)


def apply_changes(text: Column | str, changes: Column) -> Column:
    """The changes (original, corrected), one after the other, each at its first occurrence."""
    return F.aggregate(changes, _col(text), lambda acc, c: replace_first(acc, c["original"], c["corrected"]))


def is_hint(reply: Column | str) -> Column:
    return F.startswith(_col(reply), F.lit("HINT:"))


def hinted_word(reply: Column | str) -> Column:
    """The quoted word of a hint, apostrophes included; empty without one."""
    return F.regexp_extract(_col(reply), r"\"([\w']+)\"", 1)


def map_get(m: Column, key: Column, default: Column) -> Column:
    """The value of the key, or the default where there is none or it is null."""
    return F.coalesce(F.try_element_at(m, key), default)


def map_put(m: Column, key: Column, value: Column) -> Column:
    """The map with this value of the key, in place of another."""
    return F.map_concat(map_delete(m, key), F.create_map(key, value))


def map_delete(m: Column, key: Column) -> Column:
    """The map without the key."""
    return F.map_filter(m, lambda k, _: k != key)
