"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of snippets of
labelled texts.  A text is encoded with every dictionary, in blocks so that a
dictionary helps all along a long text, and the language with the smallest sum
of encoded bytes wins.  Narrow margins are rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import fold

#: Snippets per language in a dictionary and characters of each: the documented bound of the fit.
SNIPPETS, SNIPPET_CHARS = 48, 2000
BLOCK, LEVEL = 4096, 5
#: Bytes saved over the second language, by bytes of text, under which a prediction is rejected.
MIN_MARGIN = 0.001
#: What is no letter of ASCII is blank: symbols and digits tell nothing of a language.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS)


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2) -> dict[str, bytes]:
    """Raw dictionary content per language, from rows outside the held-out fold; languages with more of them come first.

    Every labelled row takes part: each is hashed into one of SNIPPETS buckets of its
    language and the smallest hash of a bucket wins, which aggregates on the map side
    and is the same at any partitioning.  What reaches the driver is at most SNIPPETS
    snippets for each language.
    """
    learn = docs.filter(~fold(id_col, modulus, remainder) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    learn = learn.select(F.col(lang_col).alias("_l"), F.lower(text_col).alias("_t"), F.xxhash64(text_col).alias("_h")).withColumn("_b", F.pmod("_h", F.lit(SNIPPETS)))
    best = learn.groupBy("_l", "_b").agg(F.min("_h").alias("_h"))
    at = (F.pmod(F.shiftright("_h", 8), F.greatest(F.length("_t") - SNIPPET_CHARS, F.lit(0)) + 1) + 1).cast("int")
    snippets = learn.join(F.broadcast(best), ["_l", "_b", "_h"]).groupBy("_l", "_b").agg(F.min(F.substring("_t", at, F.lit(SNIPPET_CHARS))).alias("s"))
    rows = {r["_l"]: r["count"] for r in learn.groupBy("_l").count().collect()}
    by: dict[str, list[str]] = {lang: [] for lang in sorted(rows, key=lambda x: (-rows[x], x))}
    for r in snippets.orderBy("_l", "_b").collect():
        by[r["_l"]].append(r["s"])
    return {lang: encoded("\n".join(s)) for lang, s in by.items()}


def language_of(dictionaries: dict[str, bytes]) -> Callable[[Column], Column]:
    """A function from a text column to a struct lang_pred, score, margin."""
    langs = list(dictionaries)
    raw = [dictionaries[x] for x in langs]

    @F.pandas_udf("lang_pred string, score double, margin double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as z

        dicts = [z.ZstdCompressionDict(x, dict_type=z.DICT_TYPE_RAWCONTENT) for x in raw]
        for d in dicts:
            d.precompute_compress(level=LEVEL)
        encoders = [z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False) for d in dicts]

        def one(text: str | None) -> tuple[str, float, float]:
            if not text or not encoders or not any(map(str.isalpha, text)):
                return "und", 0.0, 0.0
            data = encoded(text)
            blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = [sum(len(e.compress(b)) for b in blocks) for e in encoders]
            least = min(sizes)
            at = sizes.index(least)
            margin = min((s - least for i, s in enumerate(sizes) if i != at), default=least) / len(data)
            return langs[at], 1 / sum(2.0 ** -min(60, (s - least) / 2) for s in sizes), margin

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score", "margin"])

    return run


def is_rejected(found: Column, min_margin: float = MIN_MARGIN) -> Column:
    return (found["lang_pred"] == "und") | (found["margin"] < min_margin)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1), margin, rejected.

    A null text and one without a letter get 'und', score 0 and are rejected; so does
    everything when nothing was learned.  Equal sizes go to the language with
    more learned rows.  Repeated rows give repeated results.  Other columns are not read.
    """
    found = docs.select(F.col(id_col), language_of(dictionaries)(F.col(text_col)).alias("_p"))
    return found.select(id_col, "_p.*", is_rejected(F.col("_p"), min_margin).alias("rejected"))


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without the rows whose language is rejected, all columns as they were.  Null texts and those without a letter are; repeated rows go or stay together; an empty table stays empty."""
    return docs.filter(~is_rejected(language_of(dictionaries)(F.col(text_col)), min_margin))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on docs' own labelled rows, then predict all of docs."""
    return predict(docs, fit_dictionaries(docs, id_col, text_col, lang_col), id_col, text_col)
