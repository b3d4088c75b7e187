"""Homophones: which tokens have any, and the script that reads a sentence out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import clean, clean_keeping_apostrophes, split_words


def scan(sentences: DataFrame, homophones: DataFrame, key: str = "key", text: str = "sentence", keep_apostrophes: bool = True) -> DataFrame:
    """key, index, token, word, members: one row for each token that has homophones."""
    rows = sentences.select(key, F.posexplode(split_words(text)).alias("index", "token"))
    word = clean_keeping_apostrophes("token") if keep_apostrophes else clean("token", unicode=True)
    return rows.withColumn("word", word).join(homophones.select("word", "members"), "word").select(key, "index", "token", "word", "members")


def speech_script(sentence: Column | str, wrong: Column, right: Column, wrong_means: Column, right_means: Column) -> Column:
    """Tokens in order; each that is the wrong word becomes a pause, what it means, and a question."""
    unknown = F.lit("unknown")
    ask = lambda t: F.concat(F.lit("[pause] "), F.upper(t), F.lit(". "), F.upper(wrong), F.lit(" means "), F.coalesce(wrong_means, unknown), F.lit(". Did you mean "), F.upper(right), F.lit(", as in "), F.coalesce(right_means, unknown), F.lit("?"))
    return F.array_join(F.transform(split_words(sentence), lambda t: F.when(clean_keeping_apostrophes(t) == F.lower(wrong), ask(t)).otherwise(t)), " ")


def speech_scripts(sentence: Column | str, groups: Iterable[list[str]], means: dict[str, str]) -> Column:
    """As speech_script for every token that has homophones: the question is for the first other word of its group.

    The groups are a constant of the query: within the row, no shuffle.
    """
    asked = {}
    for group in groups:
        for word in group:
            other = next((w for w in group if w != word), None)
            if other and word not in asked:
                asked[word] = f". {word.upper()} means {means.get(word, 'unknown')}. Did you mean {other.upper()}, as in {means.get(other, 'unknown')}?"
    known = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])
    told = lambda t: F.try_element_at(known, clean_keeping_apostrophes(t))
    return F.array_join(F.transform(split_words(sentence), lambda t: F.coalesce(F.concat(F.lit("[pause] "), F.upper(t), told(t)), t)), " ")
