"""Registered queries over the spelling operators, and the same in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.functions.similarity import lcs_length, matching_ratio
from quillwork.operators import align, channel, correct, datasets, evaluate, homophones, log, marks, ordering, pairs
from quillwork.operators.sound_index import SoundIndex
from quillwork.sources import constants as C
from quillwork.sources import ingest, readers, sinks, versioned
from quillwork.sources.shared import shared_folder, shared_table
from quillwork.streaming import session, typing

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Letters that readers with dyslexia mix up: the noise of test sentences.
SWAP = ("bdpq", "dbqp")
#: A small cache of corrections, as constants.
CACHE = [("teh", "the"), ("onth", "month"), ("thon", "than"), ("erth", "earth"), ("nd", "and"), ("tion", "ton")]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if it has one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _values(words: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + w.replace("'", "''") + "')" for w in dict.fromkeys(words)) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))"
CLEAN = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: DuckDB's edit distance counts bytes: letters beyond ASCII become one byte each, capitals, which lower-cased words lack.
BYTES = "translate({}, 'óéñèüäößíêçàâîïôûùëáú', 'ABCDEFGHIJKLMNOPQRSTU')"
CACHE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CACHE) + ")"


def noised(x: Column | str) -> Column:
    return F.translate(x, *SWAP)


# --- words -------------------------------------------------------------------------------------------------------


def english_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(T.words("text")).alias("word"))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.explode(T.words("text")).alias("word")).distinct()


EN = f"en AS (SELECT unnest({WORDS.format('text')}) AS word FROM documents WHERE lang = 'en')"
BM = f"bm AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS word FROM benchmark)"


@query(f"WITH {EN} SELECT word, count(*) AS n FROM en GROUP BY word")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return english_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH w AS (SELECT lang, unnest({WORDS.format('text')}) AS word FROM documents) SELECT lang, word, count(*) AS n FROM w GROUP BY ALL")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every language."""
    words = _t(spark, sf_dir, "documents").select("lang", F.explode(T.words("text")).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\s+|\S+') AS ts FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(ts, 1) - 1 AS token_index, unnest(ts) AS token FROM t)
SELECT conv_id, turn, token_index::int AS token_index, token,
       coalesce(sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY token_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS position
FROM e""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return correct.tokens(rows, "key", "text").select("key.conv_id", "key.turn", F.col("index").alias("token_index"), "token", "position")


@query(f"WITH {EN}, {BM} SELECT word, count(*) AS n FROM en WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM bm) GROUP BY word")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = word_frequency(spark, sf_dir).filter("length(word) >= 2")
    return counted.join(benchmark_words(spark, sf_dir), "word", "left_anti")


@query(f"""
WITH w AS (SELECT lang, unnest({WORDS.format('text')}) AS word FROM documents)
SELECT lang, count(*) AS n_tokens, count(*) FILTER (word IN (SELECT * FROM {_values(C.VALID_WORDS)})) AS n_valid FROM w GROUP BY lang""")
def valid_word_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "documents").select("lang", F.explode(T.words("text")).alias("word"))
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("word").isin(C.VALID_WORDS)).alias("n_valid"))


@query(r"SELECT lang, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')))::bigint AS n_words, count(*) AS n_docs FROM documents GROUP BY lang")
def whitespace_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.count_words("text").cast("long")).alias("n_words"), F.count(F.lit(1)).alias("n_docs"))


# --- similarity --------------------------------------------------------------------------------------------------


def swapped_pairs(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Of English words, or of those given."""
    return (english_words(spark, sf_dir) if words is None else words).select(noised("word").alias("misspelling"), F.col("word").alias("correct")).distinct().filter("misspelling <> correct")


SWAPPED = f"{EN}, p AS (SELECT DISTINCT translate(word, 'bdpq', 'dbqp') AS misspelling, word AS correct FROM en WHERE translate(word, 'bdpq', 'dbqp') <> word)"


@query(f"""
WITH {SWAPPED}, h AS (SELECT levenshtein(misspelling, correct)::int AS edit_distance, count(*) AS n FROM p GROUP BY 1)
SELECT edit_distance, n, n / sum(n) OVER () * 100 AS pct FROM h""")
def edit_distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.distance_histogram(swapped_pairs(spark, sf_dir))


@query(f"WITH {SWAPPED} SELECT count(*) AS n_pairs, count(DISTINCT lower(correct)) AS n_correct FROM p")
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_statistics(swapped_pairs(spark, sf_dir))


@query(f"WITH {SWAPPED} SELECT misspelling, correct, levenshtein(lower(misspelling), lower(correct))::int AS edit_distance, (length(misspelling) - length(correct))::int AS len_diff FROM p")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.with_distance(swapped_pairs(spark, sf_dir))


@query(f"WITH {SWAPPED} SELECT misspelling, correct, round(1 - levenshtein(misspelling, correct) / greatest(length(misspelling), length(correct))::double, 9) AS similarity FROM p")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillwork.functions.similarity import edit_similarity as similar

    return swapped_pairs(spark, sf_dir).withColumn("similarity", F.round(similar(F.col("misspelling"), F.col("correct")), 9))


def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words and benchmark words with the same two last letters and about the same length."""
    ending = lambda c: F.substring(c, -2, 2)
    words = unknown_words(spark, sf_dir).select("word", ending("word").alias("e"), F.length("word").alias("n"))
    known = benchmark_words(spark, sf_dir).filter("length(word) >= 2").select(F.col("word").alias("candidate"), ending("word").alias("e"), F.explode(F.array(*[F.length("word") + d for d in (-1, 0, 1)])).alias("n"))
    return words.join(known, ["e", "n"]).select("word", "candidate")


def blocked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.best_matches(correct.scored(correct.contenders(blocked_pairs(spark, sf_dir), word="word"), "word"))


LCS = "list_reduce(list_prepend(list_transform(range(0, length(candidate) + 1), lambda i: 0), list_transform(string_split(word, ''), lambda c: [ascii(c)])), lambda r, ch: list_transform(r, lambda v, j: greatest(v, coalesce(list_max(list_transform(range(2, j + 1), lambda k: CASE WHEN ascii(candidate[k - 1]) = ch[1] THEN r[k - 1] + 1 ELSE 0 END)), 0))))[-1]"
SCORED = f"""{EN}, {BM},
u AS (SELECT DISTINCT word FROM en WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM bm)),
c AS (SELECT u.word, bm.word AS candidate FROM u JOIN bm ON right(u.word, 2) = right(bm.word, 2) AND abs(length(u.word) - length(bm.word)) <= 1 AND length(bm.word) >= 2),
l AS (SELECT *, {LCS} AS lcs, greatest(length(word), length(candidate))::double AS far FROM c),
s AS (SELECT word, candidate, (1 - abs(length(word) - length(candidate)) / far) * 0.1::double + (CASE WHEN word[1] = candidate[1] THEN 1.0::double ELSE 0.5::double END) * 0.2::double
      + (lcs / far) * 0.3::double + (1 - levenshtein(word, candidate) / far) * 0.4::double AS score FROM l),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY word ORDER BY score DESC, candidate))"""


@query(f"WITH {SCORED} SELECT word, candidate, round(score, 9) AS score FROM r WHERE rn = 1")
def blended_score_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked_matches(spark, sf_dir).select("word", "candidate", F.round("score", 9).alias("score"))


@query(f"""
WITH {SCORED}, k AS (SELECT word, candidate, CASE WHEN second > score * 0.8::double THEN score * 0.7::double ELSE score END AS confidence FROM r WHERE rn = 1)
SELECT word, CASE WHEN confidence > 0.3 THEN candidate END AS best_match, round(confidence, 9) AS confidence, confidence > 0.5 AS accepted FROM k""")
def close_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = blocked_matches(spark, sf_dir)
    return best.select("word", "best_match", F.round("confidence", 9).alias("confidence"), (F.col("confidence") > correct.ACCEPT).alias("accepted"))


def dictionary_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in dictionary and the benchmark's words behind it, in order of the alphabet."""
    return correct.add_words(readers.dictionary(spark), benchmark_words(spark, sf_dir))


@query()
def phonetic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, known = unknown_words(spark, sf_dir).select("word"), shared_table(dictionary_of(spark, sf_dir), "dictionary")
    found = shared_table(correct.phonetic_candidates(words, correct.phonetic_index(known)), "sound-candidates")
    n = found.groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("n_candidates"))
    return correct.matches_of(found).join(n, "word").select("word", "best_match", F.round("confidence", 9).alias("confidence"), "n_candidates")


@query()
def phonetic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept index of the built-in dictionary and the benchmark's words, to which the words of documents are added: how many words each code has, and the first of them."""
    name = f"sounds_{uuid.uuid4().hex}"
    index = SoundIndex.create(dictionary_of(spark, sf_dir), name, shared_folder(spark, "sounds"))
    index.add(_t(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("word")))
    return index.table.groupBy("code").agg(F.count(F.lit(1)).alias("n_words"), F.min(F.struct("dict_pos", "word"))["word"].alias("first_word"))


@query()
def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", "text", nxt.alias("next")).filter("next IS NOT NULL").select("conv_id", "turn", F.round(matching_ratio("text", "next"), 9).alias("ratio"))


@query()
def hybrid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn; only rows of equal conv_id, turn and text are one, their key holding the text's hash."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("sentence")).distinct()
    part = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = rows.select(F.concat_ws("-", part(F.col("conv_id")), part(F.col("turn")), part(F.sha2("sentence", 256))).alias("key"), "sentence")
    cache = spark.createDataFrame(CACHE, "word string, correction string")
    found = correct.check_sentences(rows, dictionary_of(spark, sf_dir), cache)
    return found.select("key", F.inline("corrections"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swapped words of documents, their source's number being their precedence."""
    docs = _t(spark, sf_dir, "documents")
    rows = docs.select("source", F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("priority"), "doc_id", F.posexplode(T.words("text")).alias("pos", "correct"))
    return rows.withColumn("misspelling", noised("correct")).filter("misspelling <> correct")


DOC_PAIRS = f"""d AS (SELECT source, regexp_extract(source, '(\\d+)$', 1)::int AS priority, doc_id, {WORDS.format('text')} AS ws FROM documents),
e AS (SELECT source, priority, doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS correct FROM d),
p AS (SELECT *, translate(correct, 'bdpq', 'dbqp') AS misspelling FROM e WHERE translate(correct, 'bdpq', 'dbqp') <> correct),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY misspelling, correct ORDER BY priority, doc_id, pos) AS rn FROM p) WHERE rn = 1)"""


def model_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents and how often they occur: what the learned model takes to be meant."""
    return frequent_words(word_frequencies(spark, sf_dir))


def frequent_words(counted: DataFrame) -> DataFrame:
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 3")


@query()
def learned_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the pairs of swapped words teach a model; it corrects the misspellings of the others."""
    counted = shared_table(word_frequencies(spark, sf_dir), "word-frequencies")  # the texts are read once
    pairs = shared_table(swapped_pairs(spark, sf_dir, counted.filter("lang = 'en'")), "swapped-pairs").withColumn("_fold", F.crc32("correct") % 5)
    model = channel.LearnedModel(channel.fit_channel(pairs.filter("_fold <> 0").select("misspelling", "correct")), frequent_words(counted))
    held_out = pairs.filter("_fold = 0").select("misspelling", "correct")
    asked = held_out.select(F.col("misspelling").alias("word")).distinct()
    told = model.corrections(asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return held_out.join(told, held_out["misspelling"] == told["word"], "left").select("misspelling", "correct", "correction", F.round("cost", 9).alias("cost"))


# --- sentences ---------------------------------------------------------------------------------------------------


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns, noised; and the same, clean, without the fourth word."""
    rows = _t(spark, sf_dir, "conversations").withColumn("w", T.split_words("text"))
    corrected = F.array_join(F.concat(F.slice("w", 1, 3), F.slice("w", 5, 1 << 30)), " ")
    return rows.select("conv_id", "turn", noised(F.array_join("w", " ")).alias("original"), corrected.alias("corrected"))


ENDS = r"lower(regexp_replace({}, '^[^a-zA-Z0-9_'']+|[^a-zA-Z0-9_'']+$', '', 'g'))"


@query(rf"""
WITH f AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, translate(array_to_string(w, ' '), 'bdpq', 'dbqp') AS original, array_to_string(list_concat(w[1:3], w[5:]), ' ') AS corrected FROM f),
q AS (SELECT conv_id, turn, string_split_regex(original, '\s+') AS a,
      string_split_regex(trim(regexp_replace(regexp_replace(corrected, '^(here''?s?\s+(the\s+)?corrected\s+(sentence|text)[:\s]*)', '', 'i'), '^(corrected[:\s]*)', '', 'i')), '\s+') AS b FROM p),
a AS (SELECT conv_id, turn, generate_subscripts(a, 1) AS i, unnest(a) AS o FROM q WHERE abs(len(a) - len(b)) <= 3),
b AS (SELECT conv_id, turn, generate_subscripts(b, 1) AS j, unnest(b) AS c FROM q),
x AS (SELECT conv_id, turn, i, j, o, {ENDS.format('o')} AS oc, {ENDS.format('c')} AS cc FROM a JOIN b USING (conv_id, turn) WHERE j BETWEEN i - 2 AND i + 2),
s AS (SELECT *, CASE WHEN oc = cc THEN 1.0::double ELSE 1 - levenshtein({BYTES.format('oc')}, {BYTES.format('cc')}) / greatest(length(oc), length(cc))::double END AS sim FROM x
      WHERE length(oc) >= 2 AND cc <> '' AND NOT list_contains({_list(C.VALID_WORDS)}, oc)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, i ORDER BY sim + CASE WHEN i = j THEN 0.1::double ELSE 0.0::double END DESC, j) AS rn FROM s WHERE sim > 0.3),
d AS (SELECT conv_id, turn, i, regexp_extract(o, '[a-zA-Z'',]+') AS original, cc FROM r WHERE rn = 1 AND cc <> oc)
SELECT conv_id, turn, original, CASE WHEN original = upper(original) THEN upper(cc) WHEN original[1] = upper(original[1]) THEN upper(cc[1]) || cc[2:] ELSE cc END AS corrected,
       count(*) AS n FROM d WHERE original <> '' GROUP BY ALL""")
def sentence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.sentence_changes(sentence_pairs(spark, sf_dir), "conv_id", "turn", upper=T.upper_by_letter)
    return found.groupBy("conv_id", "turn", "original", "corrected").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
WITH p AS (SELECT {WORDS.format("translate(text, 'bdpq', 'dbqp')")} AS a, {WORDS.format('text')} AS b FROM conversations),
z AS (SELECT unnest(list_zip(a, b)) AS p FROM p WHERE len(a) = len(b)),
m AS (SELECT p[1] AS misspelling, p[2] AS correct FROM z)
SELECT misspelling, correct, count(*) AS n FROM m
WHERE misspelling <> correct AND length(misspelling) >= 3 AND length(correct) >= 3 AND abs(length(misspelling) - length(correct)) <= 3
  AND NOT list_contains({_list(C.CODE_TERMS)}, misspelling) AND NOT list_contains({_list(C.CODE_TERMS)}, correct)
  AND NOT (list_contains({_list(C.MEANING_WORDS)}, misspelling) AND list_contains({_list(C.MEANING_WORDS)}, correct))
  AND NOT ((misspelling || 's' = correct OR correct || 's' = misspelling) AND length(misspelling) > 4 AND length(correct) > 4)
GROUP BY ALL""")
def typo_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations")
    found = rows.select(F.inline(pairs.word_typos(noised("text"), "text")))
    return found.groupBy("misspelling", "correct").agg(F.count(F.lit(1)).alias("n"))


CACHED = rf"""
t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ts, text FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(ts, 1) AS i, unnest(ts) AS token, text FROM t),
c AS (SELECT e.*, k.correction FROM e LEFT JOIN (SELECT * FROM {CACHE_SQL} v(word, correction)) k ON {CLEAN.format('e.token')} = k.word),
g AS (SELECT conv_id, turn, count(correction) AS cache_hits,
      string_agg(CASE WHEN correction IS NULL THEN token ELSE correction || regexp_replace(token, '[\p{{L}}\p{{N}}_]', '', 'g') END, ' ' ORDER BY i) AS joined FROM c GROUP BY conv_id, turn),
a AS (SELECT t.conv_id, t.turn, coalesce(g.cache_hits, 0) AS cache_hits, CASE WHEN g.cache_hits > 0 THEN g.joined ELSE t.text END AS corrected, coalesce(g.cache_hits, 0) < 2 AS asked
      FROM t LEFT JOIN g USING (conv_id, turn))"""


def keyed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("sentence"))


@query(f"WITH {CACHED} SELECT * FROM a")
def apply_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correct.rewrite_sentences(keyed_sentences(spark, sf_dir), spark.createDataFrame(CACHE, "word string, correction string"))
    return found.select("key.conv_id", "key.turn", "cache_hits", "corrected", "asked")


#: What a model replies to every sentence that it is asked for: four changes, of which one is valid already and one changes nothing.
REPLY = "CHANGES: ing->ung, the->teh, onth->Onth, schen->chen"


@query(f"""
WITH {CACHED},
b AS (SELECT *, strpos(lower(corrected), 'ing') AS p FROM a), c1 AS (SELECT *, CASE WHEN asked AND p > 0 THEN corrected[1:p - 1] || 'ung' || corrected[p + 3:] ELSE corrected END AS one FROM b),
d AS (SELECT *, strpos(lower(one), 'schen') AS q FROM c1)
SELECT conv_id, turn, cache_hits, asked, CASE WHEN asked AND q > 0 THEN one[1:q - 1] || 'chen' || one[q + 5:] ELSE one END AS corrected FROM d""")
def model_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache first; where it knows fewer than two words, the changes that a model replies."""
    rows = keyed_sentences(spark, sf_dir)
    found = correct.rewrite_sentences(rows, spark.createDataFrame(CACHE, "word string, correction string"), rows.select("key", F.lit(REPLY).alias("reply")))
    return found.select("key.conv_id", "key.turn", "cache_hits", "asked", "corrected")


HOMOPHONES_SQL = "(VALUES " + ", ".join("('" + w.replace("'", "''") + f"', {len(g)})" for g in C.HOMOPHONE_GROUPS for w in g) + ")"


@query(rf"""
WITH e AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS token FROM conversations),
w AS (SELECT conv_id, turn, lower(regexp_replace(token, '[^\p{{L}}\p{{N}}_'']', '', 'g')) AS word FROM e)
SELECT conv_id, turn, w.word, h.n_members::int AS n_members, count(*) AS n FROM w JOIN (SELECT * FROM {HOMOPHONES_SQL} v(word, n_members)) h ON w.word = h.word GROUP BY ALL""")
def homophone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("sentence"))
    found = homophones.scan(rows, readers.homophones(spark))
    return found.groupBy("key.conv_id", "key.turn", "word", F.size("members").alias("n_members")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda t:
  CASE WHEN lower(regexp_replace(t, '[^\p{{L}}\p{{N}}_'']', '', 'g')) = 'by' THEN '[pause] ' || upper(t) || '. BY means {C.DEFINITIONS['by']}. Did you mean BUY, as in {C.DEFINITIONS['buy']}?' ELSE t END), ' ') AS script
FROM conversations""")
def tts_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = lambda w: F.lit(C.DEFINITIONS[w])
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", homophones.speech_script("text", F.lit("by"), F.lit("buy"), means("by"), means("buy")).alias("script"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASKED = "MAP {" + ", ".join(f"{_sql(w)}: {_sql(f'. {w.upper()} means ' + C.DEFINITIONS.get(w, 'unknown') + f'. Did you mean {o.upper()}, as in ' + C.DEFINITIONS.get(o, 'unknown') + '?')}" for g in C.HOMOPHONE_GROUPS for w in g for o in [next(x for x in g if x != w)]) + "}"


@query(rf"""
SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda t:
  coalesce('[pause] ' || upper(t) || {ASKED}[lower(regexp_replace(t, '[^\p{{L}}\p{{N}}_'']', '', 'g'))], t)), ' ') AS script
FROM conversations""")
def tts_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read out: every word that has homophones is asked about."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", homophones.speech_scripts("text", C.HOMOPHONE_GROUPS, C.DEFINITIONS).alias("script"))


@query(r"""
WITH e AS (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: regexp_full_match(x, '[A-Za-z]+'))) AS token FROM documents),
d AS (SELECT token, count(*) AS n FROM e GROUP BY token), c AS (SELECT *, translate(lower(token), 'bdpq', 'dbqp') AS fix FROM d)
SELECT token, n, CASE WHEN token = upper(token) THEN upper(fix) WHEN token[1] = upper(token[1]) THEN upper(fix[1]) || fix[2:] ELSE fix END AS matched,
       CASE WHEN token = upper(token) THEN upper(fix) WHEN token = lower(token) THEN lower(fix) ELSE fix END AS preserved FROM c""")
def case_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _t(spark, sf_dir, "documents").select(F.explode(F.filter(T.split_words("text"), lambda w: w.rlike("^[A-Za-z]+$"))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("fix", noised(F.lower("token")))
    return counted.select("token", "n", T.match_case("token", "fix").alias("matched"), T.preserve_case("token", "fix").alias("preserved"))


@query(rf"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+') AS ts FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(ts, 1) AS i, unnest(ts) AS shown FROM t),
p AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS start FROM e)
SELECT conv_id, turn, start, (start + length(shown))::int AS stop, shown,
       CASE WHEN shown = upper(shown) THEN upper(c.correction) WHEN shown = lower(shown) THEN lower(c.correction) ELSE c.correction END AS correction
FROM p JOIN (SELECT * FROM {CACHE_SQL} v(word, correction)) c ON lower(p.shown) = c.word""")
def mark_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    cache = F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("corrected")) for a, b in CACHE])
    found = marks.mark_occurrences(rows, cache)
    return found.select("key.conv_id", "key.turn", F.col("from").alias("start"), F.col("to").alias("stop"), "shown", "correction")


@query(f"""
WITH {DOC_PAIRS}, fix AS (SELECT DISTINCT misspelling, correct FROM k),
tx AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+') AS ts FROM documents),
ex AS (SELECT doc_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS shown FROM tx),
px AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS start FROM ex)
SELECT doc_id, start, (start + length(shown))::int AS stop, shown,
       CASE WHEN shown = upper(shown) THEN upper(fix.correct) WHEN shown = lower(shown) THEN lower(fix.correct) ELSE fix.correct END AS correction
FROM px JOIN fix ON lower(px.shown) = fix.misspelling""")
def mark_all_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that documents give, marked in all documents."""
    known = pair_keep_first(spark, sf_dir).select(F.col("misspelling").alias("original"), F.col("correct").alias("corrected"))
    found = marks.mark_all(_t(spark, sf_dir, "documents"), shared_table(known, "pairs"), "doc_id", "text")
    return found.select("doc_id", F.col("from").alias("start"), F.col("to").alias("stop"), "shown", "correction")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head
FROM conversations""")
def carry_forward_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(so_far).alias("head"))


# --- replies of models -------------------------------------------------------------------------------------------

@query(rf"""
WITH f AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1] AS w FROM conversations),
s AS (SELECT *, regexp_replace(regexp_replace('Here''s the corrected sentence: ' || text, '^(here''?s?\s+(the\s+)?corrected\s+(sentence|text)[:\s]*)', '', 'i'), '^(corrected[:\s]*)', '', 'i') AS said FROM f)
SELECT conv_id, turn, {STRIP.format('said')} AS sentence, {STRIP.format("split_part(" + STRIP.format("text || chr(10) || 'more'") + ", chr(10), 1)")} AS answer,
       regexp_extract(split_part({STRIP.format("text || chr(10) || 'lines'")}, chr(10), 1), '(\S+)', 1) AS word,
       regexp_extract('HINT: "' || coalesce(w, '') || '" means ' || text, '"([a-zA-Z0-9_'']+)"', 1) AS hinted, true AS is_hint FROM s""")
def reply_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns with what models put around their replies, cleaned."""
    rows = _t(spark, sf_dir, "conversations")
    wrapped = F.concat(F.lit("Here's the corrected sentence: "), "text")
    thought = F.concat(F.lit("<think>hm</think> "), "text", F.lit("\nmore"))
    said = F.concat(F.lit("  "), "text", F.lit("\nlines"))
    hint = F.concat(F.lit('HINT: "'), F.coalesce(F.try_element_at(T.split_words("text"), F.lit(1)), F.lit("")), F.lit('" means '), "text")
    return rows.select("conv_id", "turn", T.strip_reply_prefix(wrapped).alias("sentence"), T.strip_thinking(thought).alias("answer"), T.first_word(said).alias("word"), T.hinted_word(hint).alias("hinted"), T.is_hint(hint).alias("is_hint"))


@query("""
WITH r AS (SELECT conv_id, turn, text, strpos(lower(text), 'the') AS a FROM conversations),
b AS (SELECT *, CASE WHEN a > 0 THEN text[1:a - 1] || 'teh' || text[a + 3:] ELSE text END AS one FROM r),
c AS (SELECT *, strpos(lower(one), 'on') AS n FROM b)
SELECT conv_id, turn, CASE WHEN n > 0 THEN one[1:n - 1] || 'no' || one[n + 2:] ELSE one END AS changed FROM c""")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changes after each other, each at its first occurrence."""
    changes = F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("corrected")) for a, b in (("the", "teh"), ("on", "no"))])
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.apply_changes("text", changes).alias("changed"))


@query("""
WITH t AS (SELECT conv_id, turn, text, strpos(text, ' ') AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN p > 0 THEN 'FIRST' || text[p:] WHEN text IS NOT NULL THEN 'FIRST' END AS accepted FROM t""")
def accept_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the first blank, or the whole text, replaced by its correction."""
    rows = _t(spark, sf_dir, "conversations").withColumn("stop", F.when(F.instr("text", " ") > 0, F.instr("text", " ") - 1).otherwise(F.length("text")))
    return rows.select("conv_id", "turn", marks.accept_correction(F.col("text"), F.lit(0), F.col("stop"), F.lit("FIRST")).alias("accepted"))


@query(rf"""
WITH t AS (SELECT conv_id, turn, text, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[2:], ' ') AS reply FROM conversations)
SELECT conv_id, turn, contains(lower(text), lower(reply)) AS has_reply, {STRIP.format('text')} = {STRIP.format('reply')} AS same,
       abs(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) - len(list_filter(string_split_regex(reply, '\s+'), lambda x: x <> ''))) <= 1 AS kept_words FROM t""")
def pass_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").withColumn("reply", F.array_join(F.slice(T.split_words("text"), 2, 1 << 30), " "))
    kept = F.abs(T.count_words("text") - T.count_words("reply")) <= 1
    return rows.select("conv_id", "turn", evaluate.reply_contains(F.col("text"), F.col("reply")).alias("has_reply"), evaluate.same_trimmed(F.col("text"), F.col("reply")).alias("same"), kept.alias("kept_words"))


@query(f"WITH {SWAPPED}, c AS (SELECT misspelling AS word, correct AS candidate FROM p) SELECT word, candidate, {LCS}::int AS lcs FROM c")
def common_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = swapped_pairs(spark, sf_dir).select(F.col("misspelling").alias("word"), F.col("correct").alias("candidate"))
    return rows.withColumn("lcs", lcs_length("word", "candidate"))


# --- pairs and training rows -------------------------------------------------------------------------------------


@query(f"WITH {DOC_PAIRS} SELECT misspelling, correct, priority, doc_id, pos::int AS pos, source FROM k")
def pair_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.keep_first(document_pairs(spark, sf_dir), "priority", "doc_id", "pos")


@query(f"""
WITH {DOC_PAIRS}, t AS (SELECT source, count(*) AS total FROM p GROUP BY source), u AS (SELECT source, count(*) AS unique_new FROM k GROUP BY source)
SELECT source, total, coalesce(unique_new, 0) AS unique_new, coalesce(unique_new, 0) / (SELECT sum(unique_new) FROM u) * 100 AS pct FROM t LEFT JOIN u USING (source)""")
def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.source_statistics(document_pairs(spark, sf_dir), "priority", "doc_id", "pos")


def benchmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_words(spark, sf_dir).select(noised("word").alias("misspelling"), F.col("word").alias("correct")).filter("misspelling <> correct")


BM_PAIRS = f"{BM}, p AS (SELECT translate(word, 'bdpq', 'dbqp') AS misspelling, word AS correct FROM bm WHERE translate(word, 'bdpq', 'dbqp') <> word)"


TYPOS = rf"""
tp AS (SELECT {WORDS.format("translate(text, 'bdpq', 'dbqp')")} AS a, {WORDS.format('text')} AS b FROM conversations),
tz AS (SELECT unnest(list_zip(a, b)) AS p FROM tp WHERE len(a) = len(b)),
ty AS (SELECT DISTINCT p[1] AS misspelling, p[2] AS correct FROM tz WHERE p[1] <> p[2]
       AND length(p[1]) >= 3 AND length(p[2]) >= 3 AND abs(length(p[1]) - length(p[2])) <= 3
       AND NOT list_contains({_list(C.CODE_TERMS)}, p[1]) AND NOT list_contains({_list(C.CODE_TERMS)}, p[2])
       AND NOT (list_contains({_list(C.MEANING_WORDS)}, p[1]) AND list_contains({_list(C.MEANING_WORDS)}, p[2]))
       AND NOT ((p[1] || 's' = p[2] OR p[2] || 's' = p[1]) AND length(p[1]) > 4 AND length(p[2]) > 4))"""
CORPORA = f"""{BM_PAIRS}, {TYPOS},
dw AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS correct FROM documents),
u AS (SELECT 0 AS priority, 'typos' AS source, misspelling, correct FROM ty UNION ALL SELECT 1, 'benchmark', misspelling, correct FROM p
      UNION ALL SELECT 2, 'documents', translate(correct, 'bdpq', 'dbqp'), correct FROM dw WHERE translate(correct, 'bdpq', 'dbqp') <> correct),
f AS (SELECT misspelling, correct, min(priority) AS priority, min_by(source, priority) AS source FROM u GROUP BY ALL)"""


def corpora(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """Three corpora of pairs, by falling precedence: typos mined from turns, swapped words of the benchmark, and of documents."""
    typos = _t(spark, sf_dir, "conversations").select(F.inline(pairs.word_typos(noised("text"), "text"))).distinct()
    words = _t(spark, sf_dir, "documents").select(F.explode(T.words("text")).alias("correct")).distinct()
    swapped = words.select(noised("correct").alias("misspelling"), "correct").filter("misspelling <> correct")
    return [("typos", typos), ("benchmark", benchmark_pairs(spark, sf_dir)), ("documents", swapped)]


@query(rf"""
WITH r AS (SELECT {WORDS.format("translate(text, 'bdpq', 'dbqp')")} AS a, {WORDS.format('text')} AS b FROM conversations WHERE role = 'user' AND turn % 4 <> 2),
z AS (SELECT unnest(list_zip(a, b)) AS p FROM r WHERE len(a) = len(b))
SELECT DISTINCT p[1] AS misspelling, p[2] AS correct FROM z WHERE p[1] <> p[2] AND length(p[1]) >= 3 AND length(p[2]) >= 3 AND abs(length(p[1]) - length(p[2])) <= 3
  AND NOT list_contains({_list(C.CODE_TERMS)}, p[1]) AND NOT list_contains({_list(C.CODE_TERMS)}, p[2])
  AND NOT (list_contains({_list(C.MEANING_WORDS)}, p[1]) AND list_contains({_list(C.MEANING_WORDS)}, p[2]))
  AND NOT ((p[1] || 's' = p[2] OR p[2] || 's' = p[1]) AND length(p[1]) > 4 AND length(p[2]) > 4)""")
def mined_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as commits, each turn an edit: those of users are typo fixes, some in another language; written as JSON lines and mined."""
    folder = shared_folder(spark, "commits")
    lang = F.when(F.col("turn") % 4 == 2, F.lit("fra")).otherwise(F.lit("eng"))
    edit = F.struct((F.col("role") == "user").alias("is_typo"), F.struct(noised("text").alias("text"), lang.alias("lang")).alias("src"), F.struct(F.col("text"), lang.alias("lang")).alias("tgt"))
    # One turn a commit: a commit with all turns of a conversation would be one value.
    _t(spark, sf_dir, "conversations").select(F.array(edit).alias("edits")).write.option("compression", "gzip").json(folder)
    return pairs.mine_commits(readers.read_typo_commits(spark, folder))


@query(f"""
WITH {BM}, c AS (SELECT generate_subscripts({_list(C.DICTIONARY)}, 1) - 1 AS dict_pos, unnest({_list(C.DICTIONARY)}) AS word),
n AS (SELECT word, row_number() OVER (ORDER BY word) AS n FROM bm WHERE word NOT IN (SELECT word FROM c))
SELECT dict_pos::int AS dict_pos, word FROM c UNION ALL SELECT ((SELECT max(dict_pos) FROM c) + n)::int, word FROM n""")
def extended_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in dictionary with the benchmark's words added behind it."""
    return dictionary_of(spark, sf_dir)


@query(f"WITH {CORPORA} SELECT misspelling, correct, source FROM f")
def combined_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.combine_corpora(corpora(spark, sf_dir))[0]


@query(f"""
WITH {CORPORA}, t AS (SELECT source, count(*) AS total FROM u GROUP BY source), n AS (SELECT source, count(*) AS unique_new FROM f GROUP BY source)
SELECT source, total, coalesce(unique_new, 0) AS unique_new, coalesce(unique_new, 0) / (SELECT sum(unique_new) FROM n) * 100 AS pct FROM t LEFT JOIN n USING (source)""")
def combined_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.combine_corpora(corpora(spark, sf_dir))[1]


@query(f"""
WITH {CORPORA}, i AS (SELECT 'words' AS source, '{C.WORD_INSTRUCTION}' AS instruction, misspelling AS input, correct AS output FROM f
UNION ALL SELECT 'changes', '{C.CHANGES_INSTRUCTION}', 'Fix spelling: "The ' || misspelling || ' is here."', 'CHANGES: ' || misspelling || '->' || correct FROM p),
n AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(chr(1), source, instruction, input, output)), source, instruction, input, output) AS row_number, count(*) OVER () AS n FROM i)
SELECT source, row_number, CASE WHEN row_number <= floor(n * 0.9::double) THEN 'train' ELSE 'eval' END AS split,
       '{C.CHAT_SYSTEM}' AS system_text, instruction || chr(10) || chr(10) || input AS user_text, output AS assistant_text FROM n""")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the combined corpora and sentences of the benchmark's pairs as one set of chat rows, cut into train and eval."""
    found = pairs.combine_corpora(corpora(spark, sf_dir))[0]
    rows = datasets.training_set([("words", datasets.word_rows(found)), ("changes", datasets.changes_rows(benchmark_pairs(spark, sf_dir)))])
    said = F.col("messages")
    return rows.select("source", "row_number", "split", said[0]["content"].alias("system_text"), said[1]["content"].alias("user_text"), said[2]["content"].alias("assistant_text"))


@query(rf"""
WITH {BM}, e AS (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS token FROM conversations),
w AS (SELECT regexp_replace(lower(token), '[^a-z'']', '', 'g') AS word FROM e)
SELECT word, count(*) AS n FROM w WHERE length(word) > 1 AND word NOT IN (SELECT word FROM bm) AND NOT list_contains({_list(C.DICTIONARY)}, word) GROUP BY word""")
def likely_misspelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns, cleaned to letters and apostrophes, that the dictionary lacks."""
    tokens = _t(spark, sf_dir, "conversations").select(F.explode(T.split_words("text")).alias("token"))
    counted = tokens.select(T.letters_only("token", apostrophes=True).alias("word")).filter("length(word) > 1").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(dictionary_of(spark, sf_dir).select("word"), "word", "left_anti")


@query(rf"""
WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')[1] AS w FROM conversations WHERE text IS NOT NULL),
k AS (SELECT t.*, c.correction FROM t LEFT JOIN (SELECT * FROM {CACHE_SQL} v(word, correction)) c ON t.w = c.word)
SELECT conv_id, turn, coalesce(correction, w, '') AS found, (correction IS NOT NULL) AS has, ({len(CACHE)} + CASE WHEN w IS NOT NULL AND correction IS NULL THEN 1 ELSE 0 END)::int AS n_put,
       ({len(CACHE)} - CASE WHEN correction IS NOT NULL THEN 1 ELSE 0 END)::int AS n_left FROM k""")
def cache_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache as a map column: the first word of each turn looked up, put and taken out."""
    word = F.coalesce(F.try_element_at(T.split_words(F.lower("text")), F.lit(1)), F.lit(""))
    cache = F.create_map(*[F.lit(x) for pair in CACHE for x in pair])
    rows = _t(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("w", word).withColumn("m", cache)
    put = F.when(F.col("w") != "", T.map_put(F.col("m"), F.col("w"), F.lit("x"))).otherwise(F.col("m"))
    return rows.select("conv_id", "turn", T.map_get(F.col("m"), F.col("w"), F.col("w")).alias("found"), F.map_contains_key("m", F.col("w")).alias("has"), F.size(put).alias("n_put"), F.size(T.map_delete(F.col("m"), F.col("w"))).alias("n_left"))


@query(f"WITH {BM_PAIRS} SELECT '{C.WORD_INSTRUCTION}' AS instruction, misspelling AS input, correct AS output FROM p")
def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.word_rows(benchmark_pairs(spark, sf_dir))


CHANGES = f"SELECT '{C.CHANGES_INSTRUCTION}' AS instruction, 'Fix spelling: \"The ' || misspelling || ' is here.\"' AS input, 'CHANGES: ' || misspelling || '->' || correct AS output FROM p"


@query(f"WITH {BM_PAIRS} {CHANGES} UNION ALL {CHANGES.replace('The ', 'I have ').replace(' is here', ' here')}")
def changes_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark_pairs(spark, sf_dir)
    return datasets.changes_rows(rows, "the").unionByName(datasets.changes_rows(rows, "have"))


@query(f"""
WITH {BM_PAIRS}, n AS (SELECT *, row_number() OVER (ORDER BY correct) AS row_number FROM p),
t AS (SELECT *, {_list(C.SENTENCE_TEMPLATES)}[(row_number - 1) % 8 + 1] AS tpl FROM n)
SELECT row_number, '{C.SENTENCE_INSTRUCTION}' AS instruction, replace(tpl, '{{}}', misspelling) AS input, replace(tpl, '{{}}', correct) AS output FROM t""")
def template_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.sentence_rows(benchmark_pairs(spark, sf_dir), "correct")


@query(f"""
WITH {BM_PAIRS}, i AS (SELECT '{C.WORD_INSTRUCTION}' AS instruction, misspelling AS input, correct AS output FROM p)
SELECT '{C.CHAT_SYSTEM}' AS system_text, instruction || chr(10) || chr(10) || input AS user_text, output AS assistant_text,
       '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input || chr(10) || chr(10) || '### Response:' || chr(10) || output AS prompt FROM i""")
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.word_rows(benchmark_pairs(spark, sf_dir)).withColumn("prompt", datasets.prompt_text())
    said = datasets.chat_messages()
    return rows.select(said[0]["content"].alias("system_text"), said[1]["content"].alias("user_text"), said[2]["content"].alias("assistant_text"), "prompt")


@query(f"""
WITH {SWAPPED}, i AS (SELECT misspelling AS input, correct AS output, md5(misspelling || chr(1) || correct) AS h FROM p),
n AS (SELECT *, row_number() OVER (ORDER BY h, input, output) AS row_number, count(*) OVER () AS n FROM i)
SELECT input, output, row_number, CASE WHEN row_number <= floor(n * 0.9::double) THEN 'train' ELSE 'eval' END AS split FROM n""")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = swapped_pairs(spark, sf_dir).select(F.col("misspelling").alias("input"), F.col("correct").alias("output"))
    return ordering.shuffled_split(rows, 0.9).select("input", "output", "row_number", "split")


@query(f"""
WITH {BM_PAIRS}, r AS (SELECT correct, 'Sure.' || chr(10) || 'changes: "' || misspelling || '" -> ' || correct || '., a->b->c, ' || correct || '->' || upper(correct) || ', the->teh, x' AS reply FROM p)
SELECT correct AS reply_of, translate(correct, 'bdpq', 'dbqp') AS original, correct AS corrected FROM r
WHERE NOT list_contains({_list(C.VALID_WORDS)}, translate(correct, 'bdpq', 'dbqp'))""")
def changes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark_pairs(spark, sf_dir)
    reply = F.concat(F.lit('Sure.\nchanges: "'), "misspelling", F.lit('" -> '), "correct", F.lit("., a->b->c, "), "correct", F.lit("->"), F.upper("correct"), F.lit(", the->teh, x"))
    return rows.select(F.col("correct").alias("reply_of"), F.inline(T.parse_changes(reply, C.VALID_WORDS)))


# --- sources and sinks, over what the tables give ---------------------------------------------------------------------


@query(f"WITH {SWAPPED} SELECT correct, misspelling, length(correct)::int AS frequency FROM p WHERE lower(misspelling) <> lower(correct)")
def headed_list_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as lists of heads and members with their counts, and read in ranges of 64 KB."""
    folder = shared_folder(spark, "headed-list")
    members = F.concat("misspelling", F.lit(" "), F.length("correct").cast("string"))
    lists = swapped_pairs(spark, sf_dir).groupBy("correct").agg(F.array_join(F.collect_list(members), "\n").alias("m"))
    lists.select(F.concat(F.lit("$"), "correct", F.lit("\n"), "m")).write.text(folder)
    return readers.read_headed_list(spark, folder, encoding="UTF-8", split_bytes=1 << 16).select("correct", "misspelling", "frequency")


@query(f"WITH {SWAPPED} SELECT misspelling, correct FROM p")
def csv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written to files whose headers differ in names and order, and read as one."""
    folder, rows = shared_folder(spark, "csv-pairs"), shared_table(swapped_pairs(spark, sf_dir), "csv-pairs-of")
    kind = F.pmod(F.crc32("correct"), F.lit(3))
    headers = (("misspelling AS wrong", "correct AS right"), ("correct AS label", "'x,y' AS note", "misspelling AS input"), ("'' AS correct", "'' AS misspelling", "correct AS right", "misspelling AS wrong"))
    for i, names in enumerate(headers):
        sinks.write_csv(rows.filter(kind == i).selectExpr(*names), f"{folder}/{i}")
    return readers.read_pair_csv(spark, [f"{folder}/{i}" for i in range(len(headers))])


@query(f"""
WITH {SWAPPED} SELECT misspelling, correct, (SELECT count(*) FROM p WHERE length(correct) % 7 <> 0) AS n_rows, (SELECT count(*) FROM p WHERE length(correct) % 7 = 0) AS n_bad, 1 AS n_missing
FROM p WHERE length(correct) % 7 <> 0""")
def ingested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as JSON lines, those of some lengths cut short: one pass reads, counts and sets these aside."""
    folder = shared_folder(spark, "json-lines")
    line = F.to_json(F.struct("misspelling", "correct"))
    cut = F.when(F.length("correct") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    swapped_pairs(spark, sf_dir).select(cut.alias("value")).write.text(folder)
    found = ingest.ingest_jsonl(spark, [folder, f"{folder}-missing"], "misspelling string, correct string")
    return found.rows.select("misspelling", "correct", F.lit(found.n_rows).cast("long").alias("n_rows"), F.lit(found.n_bad).cast("long").alias("n_bad"), F.lit(len(found.missing)).alias("n_missing"))


@query(f"""
WITH {SWAPPED}, a AS (SELECT misspelling, correct FROM p WHERE length(correct) % 2 = 0)
SELECT misspelling, correct FROM a UNION ALL SELECT misspelling, correct FROM p WHERE length(correct) % 2 = 1""")
def kept_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs added to a versioned table in two micro-batches, of which the first is repeated; the second stands once as well."""
    path, rows = shared_folder(spark, "kept-log"), shared_table(swapped_pairs(spark, sf_dir), "kept-log-of")
    for n in (0, 0, 1, 1):
        versioned.append(rows.filter(F.length("correct") % 2 == n), path, "pairs", n)
    return versioned.read(spark, path)


# --- logs and evaluation -----------------------------------------------------------------------------------------


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_100_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.last_entries(_t(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "ts", "user_id", "event_type")


@query("SELECT event_id, round(epoch((SELECT max(ts) FROM events)) - epoch(ts), 3) AS age_seconds FROM events")
def log_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before the last event each was."""
    rows = _t(spark, sf_dir, "events")
    last = rows.agg(F.max("ts").alias("_last"))
    aged = log.with_elapsed(rows.crossJoin(F.broadcast(last)), "ts", F.col("_last").cast("timestamp"))
    return aged.select("event_id", F.round("age_seconds", 3).alias("age_seconds"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a log entry of one correction; a few kinds of events stand for the sources."""
    kind = F.pmod(F.length("event_type"), F.lit(3))
    source = F.when(kind == 0, "phonetic").when(kind == 1, "llm").otherwise("cache")
    return _t(spark, sf_dir, "events").select("user_id", F.array(F.struct(F.col("event_type").alias("original"), source.alias("source"))).alias("corrections"))


@query("""
SELECT count(*) AS total, count(*) FILTER (length(event_type) % 3 = 0) AS phonetic, count(*) FILTER (length(event_type) % 3 = 1) AS llm, count(*) FILTER (length(event_type) % 3 = 2) AS cache FROM events""")
def source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.source_counts(event_log(spark, sf_dir))


@query("SELECT event_id, to_json(struct_pack(id := event_id, kind := event_type)) AS packed, (json_extract_string(props, '$') IS NOT NULL) AS is_json FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events")
    return rows.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("packed"), F.get_json_object("props", "$").isNotNull().alias("is_json"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as test results: source is the model, toxic the category, quality whether it passed."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("source").alias("model"), F.concat(F.lit("toxic"), F.col("toxic").cast("string")).alias("category"), (F.col("quality") == 1).alias("passed"), (F.col("quality") == 1).alias("correct"), (F.col("n_chars") / 1000.0).alias("time"))


JUDGED = "j AS (SELECT doc_id, source AS model, 'toxic' || toxic AS category, quality = 1 AS passed, n_chars / 1000.0::double AS time FROM labels JOIN documents USING (doc_id))"
ACCURACY = "a AS (SELECT model, sum(passed::int)::bigint AS n_correct, count(*) AS n_total, sum(passed::int) / count(*) * 100 AS accuracy, avg(time) AS avg_time, min(time) AS min_time, max(time) AS max_time FROM j GROUP BY model)"


@query(f"""
WITH {JUDGED} SELECT model, category, sum(passed::int)::bigint AS n_passed, (count(*) - sum(passed::int))::bigint AS n_failed, round(sum(passed::int) * 100.0::double / count(*), 9) AS pct
FROM j GROUP BY GROUPING SETS ((model), (model, category))""")
def suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.suite_summary(judged(spark, sf_dir)).withColumn("pct", F.round("pct", 9))


@query(f"WITH {JUDGED}, {ACCURACY} SELECT model, n_correct, n_total, round(accuracy, 6) AS accuracy, round(avg_time, 6) AS avg_time, min_time, max_time, CASE WHEN n_correct / n_total >= 0.8 THEN 'good' WHEN n_correct / n_total >= 0.6 THEN 'fair' ELSE 'poor' END AS verdict FROM a")
def model_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.accuracy(judged(spark, sf_dir)).withColumn("verdict", evaluate.verdict(F.col("n_correct") / F.col("n_total")))
    return found.withColumn("accuracy", F.round("accuracy", 6)).withColumn("avg_time", F.round("avg_time", 6))


@query(f"WITH {JUDGED}, {ACCURACY} SELECT model, round(accuracy, 6) AS accuracy FROM a ORDER BY a.accuracy DESC, model LIMIT 1")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_model(evaluate.accuracy(judged(spark, sf_dir))).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {JUDGED}, {ACCURACY} SELECT model, round(accuracy - avg_time * 5, 6) AS balance FROM a WHERE accuracy - avg_time * 5 > 0 ORDER BY accuracy - avg_time * 5 DESC, model LIMIT 1")
def best_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_balance(evaluate.accuracy(judged(spark, sf_dir))).withColumn("balance", F.round("balance", 6))


@query(f"""
WITH {JUDGED} SELECT count(*) FILTER (category = 'toxic0' AND passed) AS n_correct, count(*) FILTER (category = 'toxic0') AS n_scored, count(*) AS n_loaded,
round(count(*) FILTER (category = 'toxic0' AND passed) * 100.0::double / count(*) FILTER (category = 'toxic0'), 9) AS accuracy, round(count(*) FILTER (category = 'toxic0' AND passed) * 100.0::double / count(*), 9) AS accuracy_compat FROM j""")
def eval_set_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.eval_accuracy(judged(spark, sf_dir).withColumnRenamed("category", "instruction"), "toxic0")
    return found.withColumn("n_correct", F.col("n_correct").cast("long")).withColumn("accuracy", F.round("accuracy", 9)).withColumn("accuracy_compat", F.round("accuracy_compat", 9))


@query(f"WITH {JUDGED} SELECT doc_id, model, category, time FROM j WHERE NOT passed ORDER BY doc_id LIMIT 10")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failures(judged(spark, sf_dir), "doc_id").select("doc_id", "model", "category", "time")


WORD_CASES = f"w AS (SELECT word AS expected, translate(word, 'bdpq', 'dbqp') AS input FROM bm), o AS (SELECT expected, input, CASE WHEN length(expected) % 3 = 0 THEN input WHEN length(expected) % 3 = 1 THEN upper(expected) ELSE expected END AS reply FROM w)"


@query(f"""
WITH {BM}, {WORD_CASES} SELECT length(expected)::int AS n_letters, sum((lower(reply) = lower(expected))::int)::bigint AS n_correct, count(*) AS n_total FROM o GROUP BY 1""")
def word_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as cases; what stands for the model's reply is at times the misspelling, at times upper case, and goes on after the word."""
    cases = benchmark_words(spark, sf_dir).select(F.col("word").alias("case_id"), noised("word").alias("input"), F.col("word").alias("expected"))
    kind = F.length("expected") % 3
    reply = F.when(kind == 0, F.col("input")).when(kind == 1, F.upper("expected")).otherwise(F.col("expected"))
    outputs = cases.select(F.lit("m").alias("model"), "case_id", F.concat(F.lit(" "), reply, F.lit(" is right\nmore")).alias("output"), F.lit(0.5).alias("time"))
    scored = evaluate.score_words(cases, outputs)
    return scored.groupBy(F.length("expected").alias("n_letters")).agg(F.sum(F.col("correct").cast("long")).alias("n_correct"), F.count(F.lit(1)).alias("n_total"))


@query()
def sentence_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as cases of five categories; a model that thinks aloud and repeats each turn noised, without its last word where the category asks for word counts."""
    rows = _t(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    names = F.array(*map(F.lit, [*evaluate.LEAST_RATIO, "word_preservation"]))
    category = F.element_at(names, (F.pmod(F.xxhash64("text"), F.lit(5)) + 1).cast("int"))
    cases = rows.select(category.alias("category"), F.struct("conv_id", "turn").alias("case_id"), F.col("text").alias("input"), F.col("text").alias("expected"))
    words = T.split_words("input")
    said = F.when(F.col("category") == "word_preservation", F.array_join(F.slice(words, 1, F.size(words) - 1 - F.col("case_id.turn").cast("int") % 2), " ")).otherwise(noised(F.translate("input", "\n", " ")))
    outputs = cases.select(F.lit("m").alias("model"), "category", "case_id", F.concat(F.lit("<think>hm</think> "), said).alias("output"), F.lit(0.5).alias("time"))
    scored = evaluate.score_sentences(cases, outputs)
    return scored.select("case_id.conv_id", "case_id.turn", "category", F.round("similarity", 9).alias("similarity"), "passed")


@query()
def hybrid_check_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, noised, checked by cache, sound and a model that knows the clean turn; only where words stay unknown is it asked."""
    rows = _t(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", noised("text").alias("sentence"), "text").distinct()
    part = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = rows.select(F.concat_ws("-", part(F.col("conv_id")), part(F.col("turn")), F.sha2("text", 256)).alias("key"), "sentence", "text")
    replies = rows.groupBy("sentence").agg(F.min("text").alias("reply"))
    cache = spark.createDataFrame(CACHE, "word string, correction string")
    found = correct.check_sentences(rows.select("key", "sentence"), dictionary_of(spark, sf_dir), cache, correct.lookup_corrector(replies))
    return found.select("key", F.inline("corrections"))


STREAM_SQL = """
WITH r AS (SELECT user_id::varchar AS key, ts, event_type AS text, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events),
k AS (SELECT key, text, coalesce(before = text, false) AS skip FROM r)
SELECT key, count(*) AS n_rows, count(*) FILTER (skip) AS n_skipped, (count(*) FILTER (NOT skip) - count(DISTINCT text))::bigint AS n_hits, count(DISTINCT text) AS n_misses FROM k GROUP BY key"""


@query(STREAM_SQL)
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_type").alias("text"))
    return session.session_totals_batch(rows)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _t(spark, sf_dir, "events")
    return spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")


def ran(result: DataFrame, name: str, mode: str) -> DataFrame:
    return session.run_available(result, shared_folder(result.sparkSession, name), mode)


@query(STREAM_SQL)
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of finished sentences, run until what is there is read."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_type").alias("text"))
    return session.latest_by_key(ran(session.session_totals(rows), "stream-cache", "update"))


def learning_events(events: DataFrame) -> DataFrame:
    """Each event asks for its type and then teaches a correction of it, which carries the event's number."""
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.col("event_type").alias("word"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("correction"))


ANSWERS_SQL = """
WITH r AS (SELECT user_id::varchar AS key, event_id AS seq, event_type, lag(event_type || '-' || event_id) OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts, event_id) AS known FROM events)
SELECT key, seq, coalesce(known, event_type) AS corrected, (known IS NOT NULL)::int AS hits FROM r"""


@query(ANSWERS_SQL)
def session_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.session_answers_batch(learning_events(_t(spark, sf_dir, "events"))).select("key", "seq", "corrected", "hits")


@query(ANSWERS_SQL)
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: a session's corrections are keyed state, the latest wins."""
    return ran(session.session_answers(learning_events(event_stream(spark, sf_dir))), "stream-answers", "append").select("key", "seq", "corrected", "hits")


@query("""
WITH r AS (SELECT user_id::varchar AS key, event_id AS seq, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
           lag(event_type || '-' || event_id) OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts, event_id) AS known FROM events)
SELECT key, seq, text, coalesce(known, text) AS corrected FROM r WHERE rn <= 100""")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred answers of each session, as its state holds them at the end of the stream."""
    last = session.latest_by_key(ran(session.session_logs(learning_events(event_stream(spark, sf_dir))), "stream-log", "update"))
    return last.select("key", F.inline("entries")).select("key", "seq", "text", "corrected")


#: Turns as typed: 200 letters a second, an hour from turn to turn; pieces come up to ten seconds late, and a minute without one is a pause.
TYPED_SQL = r"""
WITH t AS (SELECT conv_id::varchar AS key, turn::bigint AS turn, regexp_extract_all(text, '(?s).{1,200}') AS ps FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
p AS (SELECT key, turn, generate_subscripts(ps, 1) - 1 AS seq, unnest(ps) AS piece FROM t),
w AS (SELECT *, turn * 3600 + seq AS s, max(turn * 3600 + seq) OVER () - 10 AS mark FROM p),
l AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY key ORDER BY s, seq, piece) > 60, false) AS gap FROM w WHERE s <= mark),
r AS (SELECT *, sum(gap::int) OVER (PARTITION BY key ORDER BY s, seq, piece ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l),
g AS (SELECT key, run, string_agg(piece, '' ORDER BY s, seq, piece) AS text, max(s) AS last, max(mark) AS mark FROM r GROUP BY key, run),
o AS (SELECT *, run < max(run) OVER (PARTITION BY key) OR last + 60 < mark AS gone, regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+') AS ss FROM g),
e AS (SELECT key, run, gone, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM o),
c AS (SELECT *, regexp_replace(s, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS sentence FROM e)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY run, i)::bigint AS number, sentence, regexp_matches(sentence, '[.!?]$') AS finished
FROM c WHERE (gone OR regexp_matches(sentence, '[.!?]$')) AND regexp_replace(sentence, '[.!?]+$', '') <> ''"""


@query(TYPED_SQL)
def stream_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns come as pieces that are being typed; sentences leave when they are finished, or when a pause has passed."""
    table = _t(spark, sf_dir, "conversations")
    pieces = typing.as_typed(spark.readStream.schema(table.schema).parquet(f"{sf_dir}/conversations.parquet*"))
    return ran(typing.typed_sentences(pieces), "stream-sentences", "append").drop("n")


@query(TYPED_SQL)
def typed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the finished table."""
    pieces = typing.as_typed(_t(spark, sf_dir, "conversations"))
    mark = shared_table(pieces.agg((F.max("ts") - F.expr("INTERVAL 10 SECONDS")).alias("_mark")), "watermark")
    return typing.typed_sentences_batch(pieces.crossJoin(F.broadcast(mark)), F.col("_mark"))


@query(ANSWERS_SQL)
def stream_handed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query runs over the earlier half of the time; what its sessions have learned is taken from its state and given to another query, which answers the later half."""
    half = _t(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) / 2).alias("half")).first()[0]
    rows = learning_events(event_stream(spark, sf_dir))
    first, second = (shared_folder(spark, f"stream-{n}") for n in ("first", "second"))
    early = session.run_available(session.session_answers(rows.filter(F.col("ts") < F.lit(half))), first, "append")
    late = session.run_available(session.session_answers(rows.filter(F.col("ts") >= F.lit(half)), session.learned(spark, first)), second, "append")
    return early.unionByName(late).select("key", "seq", "corrected", "hits")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
