"""Corrections: by sound, by cache, by a model, and the hybrid of them.

Words repeat, so everything costly runs on distinct unknown words and is joined
back.  Tables that stand for a dictionary or cache are joined on the word; Spark
broadcasts them when they are small enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.functions.phonetic import double_metaphone
from quillwork.functions.similarity import blended_score, lcs_bounds, lcs_length
from quillwork.functions.text import any_case, apply_changes, clean, keep_punctuation, letters_only, parse_changes, split_words, sums_before, tokens_with_separators
from quillwork.operators.align import once, sentence_changes
from quillwork.operators.ordering import with_row_number
from quillwork.sources.constants import VALID_WORDS
from quillwork.sources.shared import shared_table

KEEP, ACCEPT, CLOSE, CLOSE_FACTOR = 0.3, 0.5, 0.8, 0.7
#: A model: from (key, sentence) to (key, reply).  None stands for no model.
Corrector = Callable[[DataFrame], DataFrame]


def lookup_corrector(table: DataFrame) -> Corrector:
    """A deterministic model: replies by sentence from a table sentence, reply; no reply without an entry."""
    return lambda rows: rows.join(table, "sentence", "left").select("key", "reply")


def phonetic_index(dictionary: DataFrame) -> DataFrame:
    """code, word, dict_pos: a row for each code of each dictionary word; empty codes match nothing."""
    codes = F.explode(F.array_distinct(double_metaphone("word"))).alias("code")
    return dictionary.select("word", "dict_pos", codes).filter("code <> ''")


def phonetic_candidates(words: DataFrame, index: DataFrame) -> DataFrame:
    """word, candidate, code_rank, dict_pos for distinct words (lower case): candidates share a code; first code first."""
    codes = words.withColumn("_clean", letters_only("word")).filter("_clean <> ''").withColumn("_codes", double_metaphone("_clean"))
    asked = codes.select("word", "_clean", F.posexplode(F.array_distinct("_codes")).alias("code_rank", "code")).filter("code <> ''")
    met = asked.join(index.withColumnRenamed("word", "candidate"), "code").filter("candidate <> _clean")
    return met.groupBy("word", "_clean", "candidate").agg(F.min(F.struct("code_rank", "dict_pos")).alias("_p")).select("word", F.col("_clean").alias("clean"), "candidate", "_p.*")


def scored(candidates: DataFrame, word: str = "clean") -> DataFrame:
    return candidates.withColumn("score", blended_score(F.col(word), F.col("candidate"), lcs_length(word, "candidate")))


def contenders(candidates: DataFrame, key: str = "word", word: str = "clean") -> DataFrame:
    """Candidates that can still be among a word's best two: by the edit distance alone the score is known to within bounds."""
    least, most = (blended_score(F.col(word), F.col("candidate"), x) for x in lcs_bounds(F.col(word), F.col("candidate")))
    by = W.partitionBy(key)
    rows = candidates.withColumn("_least", least).withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_least"))))
    rows = rows.withColumn("_second", F.max(F.when(F.col("_rank") == 2, F.col("_least"))).over(by))
    # Room for the rounding of sums.
    return rows.filter(F.col("_second").isNull() | (most >= F.col("_second") - 1e-9)).drop("_least", "_rank", "_second")


def _confidence(first: Column, second: Column) -> Column:
    return F.when(second > first * F.lit(CLOSE), first * F.lit(CLOSE_FACTOR)).otherwise(first)


def ranked_candidates(scores: DataFrame, key: str = "word", *ties: str) -> DataFrame:
    """word, candidates: all of them, best first; ties go by the columns named, then by the alphabet."""
    order = [-F.col("score"), *map(F.col, ties), F.col("candidate")]
    rows = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))).alias("_r"))
    last = f"o{len(order) - 1}"
    return rows.select(key, F.transform("_r", lambda x: x[last]).alias("candidates"))


def best_matches(scores: DataFrame, key: str = "word", *ties: str) -> DataFrame:
    """word, candidate (the best), best_match, score, confidence from rows (word, candidate, score).

    Ties go by the columns named.  A runner-up above 0.8 of the best takes 0.3 of the
    confidence; under a confidence of 0.3 there is no best match.  Only two rows of a
    word are read, and each task cuts a word down to two before rows are moved.
    """
    order = W.partitionBy(key).orderBy(F.desc("score"), *ties, "candidate")
    top = scores.withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    at = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    rows = top.groupBy(key).agg(at(1, "candidate").alias("candidate"), at(1, "score").alias("score"), at(2, "score").alias("_second"))
    found = rows.withColumn("confidence", _confidence(F.col("score"), F.col("_second"))).drop("_second")
    return found.withColumn("best_match", F.when(F.col("confidence") > KEEP, F.col("candidate")))


def matches_of(candidates: DataFrame) -> DataFrame:
    """Best matches from phonetic_candidates."""
    return best_matches(scored(contenders(candidates)), "word", "code_rank", "dict_pos")


def phonetic_matches(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Best matches by sound of distinct words; words without a candidate are absent."""
    return matches_of(phonetic_candidates(words, phonetic_index(dictionary)))


def tokens(sentences: DataFrame, key: str = "key", text: str = "sentence") -> DataFrame:
    """key, index, token, position: words and separators with their character offset, summed up within the row."""
    rows = sentences.withColumn("_t", tokens_with_separators(text))
    placed = F.arrays_zip(F.col("_t").alias("token"), sums_before(F.transform("_t", F.length)).alias("position"))
    return rows.select(key, F.posexplode(placed).alias("index", "_p")).select(key, "index", F.col("_p.token").alias("token"), F.col("_p.position").cast("long").alias("position"))


def check_sentences(sentences: DataFrame, dictionary: DataFrame, cache: DataFrame | None = None, corrector: Corrector | None = None) -> DataFrame:
    """key, corrections: array of (position, original, corrected, source) for rows key, sentence with unique keys.

    Valid words pass; then the cache (word, correction) answers, then a match by sound of
    more than 0.5 confidence.  Where unknown words remain, the model's sentence is compared
    with the original, and changes of words not corrected yet are added at their first
    occurrence.  source tells which of cache, phonetic and llm decided.
    """

    def looked_up(tokens: DataFrame) -> DataFrame:
        words = tokens.withColumn("word", clean("token")).filter((F.length("word") >= 2) & ~F.col("word").isin(VALID_WORDS))
        return words.withColumn("_cached", F.lit(None).cast("string")) if cache is None else words.join(cache.select("word", F.col("correction").alias("_cached")), "word", "left")

    asked = looked_up(tokens(sentences))
    # Words alone need no places; read twice, worked out once.
    alone = looked_up(sentences.select(F.explode(tokens_with_separators("sentence")).alias("token")).distinct())
    open_words = shared_table(alone.filter("_cached IS NULL").select("word").distinct().join(dictionary.select("word"), "word", "left_anti"), "open-words")
    matches = phonetic_matches(open_words, dictionary).select("word", F.when(F.col("confidence") > ACCEPT, F.col("best_match")).alias("_sound"))
    unknown = open_words.join(matches, "word", "left").withColumn("_unknown", F.lit(True))
    told = asked.join(unknown, "word", "left").withColumn("corrected", F.coalesce("_cached", "_sound"))
    source = F.when(F.col("_cached").isNotNull(), "cache").otherwise("phonetic")
    one = F.struct(F.col("position").cast("int").alias("position"), F.col("word").alias("original"), "corrected", source.alias("source"))
    per = told.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("corrected").isNotNull(), one))).alias("corrections"), F.max(F.coalesce("_unknown", F.lit(False)) & F.col("corrected").isNull()).alias("_ask"))
    empty = F.filter(F.array(F.struct(F.lit(0).alias("position"), F.lit("").alias("original"), F.lit("").alias("corrected"), F.lit("").alias("source"))), lambda x: F.lit(False))
    found = sentences.select("key", "sentence").join(per, "key", "left").withColumn("corrections", F.coalesce("corrections", empty))
    if corrector is None:
        return found.select("key", "corrections")
    # Asked, compared and added to: read three times, worked out once.
    found = shared_table(found, "checked")
    replies = corrector(found.filter("_ask").select("key", "sentence"))
    told = found.filter("_ask").join(replies.filter("reply IS NOT NULL"), "key")
    # Lower-casing leaves letters up to U+00FF in their places, and none of them but a-z and A-Z is found by a-z.
    low = F.when(F.col("sentence").rlike(r"^[\x00-\xFF]*$"), F.lower("sentence"))
    told = once(told, "key", "sentence", "reply", _low=low, _have=F.transform("corrections", lambda c: c["original"]))
    more = sentence_changes(told, "key", "sentence", "_low", "_have", original="sentence", corrected="reply")
    more = more.withColumn("_name", F.lower("original")).filter(~F.array_contains("_have", F.col("_name")))
    parts = F.split("sentence", any_case(F.col("_name")), 2)
    place = F.when(F.col("_low").isNotNull(), F.position(F.col("_name"), F.col("_low")) - 1).when(F.size(parts) == 2, F.length(F.get(parts, F.lit(0)))).otherwise(-1)
    more = once(more, "key", "i", "original", "corrected", "_name", position=place).filter("position >= 0")
    # Of equal words the first counts.
    first = more.groupBy("key", "_name").agg(F.min(F.struct("i", "position", "original", "corrected")).alias("m"))
    fresh = first.groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("_more"))
    added = F.transform("_more", lambda m: F.struct(m["position"].alias("position"), m["original"].alias("original"), m["corrected"].alias("corrected"), F.lit("llm").alias("source")))
    return found.join(fresh, "key", "left").select("key", F.when(F.col("_more").isNotNull(), F.concat("corrections", added)).otherwise(F.col("corrections")).alias("corrections"))


def rewrite_sentences(sentences: DataFrame, cache: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """key, corrected, cache_hits, asked, changes: the cache first, a model's CHANGES reply (key, reply) where fewer than two words were cached.

    Cached words keep their punctuation, behind the correction.  A row is known by its key and
    sentence: keys may be null or shared, and rows come out as often as they come in; a reply
    is for all rows of its key.
    """
    given = sentences.select("key", "sentence").withColumn("_h", F.sha2("sentence", 256))
    rows = given.distinct().select("key", "_h", F.posexplode(split_words("sentence")).alias("i", "token")).withColumn("word", clean("token", unicode=True))
    looked = rows.join(cache.select("word", "correction"), "word", "left")
    new = F.when(F.col("correction").isNotNull(), keep_punctuation("token", "correction")).otherwise(F.col("token"))
    per = looked.groupBy(F.col("key").alias("_key"), F.col("_h").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("i", new.alias("t")))).alias("_t"), F.count("correction").alias("cache_hits"))
    found = given.join(per, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_of")), "left").withColumn("cache_hits", F.coalesce("cache_hits", F.lit(0)))
    found = found.withColumn("corrected", F.when(F.col("cache_hits") > 0, F.array_join(F.transform("_t", lambda x: x["t"]), " ")).otherwise(F.col("sentence"))).withColumn("asked", F.col("cache_hits") < 2)
    if replies is None:
        return found.select("key", "corrected", "cache_hits", "asked")
    told = found.join(replies, "key", "left").withColumn("changes", F.when(F.col("asked"), parse_changes("reply", VALID_WORDS)))
    return told.select("key", F.when(F.col("changes").isNotNull(), apply_changes("corrected", F.col("changes"))).otherwise(F.col("corrected")).alias("corrected"), "cache_hits", "asked", "changes")


def latest(cache_writes: DataFrame, *order: str) -> DataFrame:
    """word, correction: of several writes of a word the last counts."""
    return cache_writes.groupBy("word").agg(F.max(F.struct(*order, "correction"))["correction"].alias("correction"))


def add_words(dictionary: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary with new words (column word) behind it, in lower case, each once."""
    fresh = new.select(F.lower("word").alias("word")).distinct().join(dictionary.select("word"), "word", "left_anti")
    last = dictionary.agg(F.coalesce(F.max("dict_pos"), F.lit(-1)).alias("_last"))
    numbered = with_row_number(fresh, "word", name="_n").crossJoin(F.broadcast(last))
    return dictionary.select("dict_pos", "word").unionByName(numbered.select((F.col("_last") + F.col("_n")).cast("int").alias("dict_pos"), "word"))
