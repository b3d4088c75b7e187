"""Sources: corpora of misspellings, pair files, training rows, caches, logs, homophones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.functions.text import strip
from quillwork.sources import constants
from quillwork.sources.headed import SPLIT_BYTES, HeadedList

TYPO_SCHEMA = "edits array<struct<is_typo: boolean, src: struct<text: string, lang: string>, tgt: struct<text: string, lang: string>>>"
INSTRUCTION_SCHEMA = "instruction string, input string, output string"
LOG_SCHEMA = "timestamp timestamp, input string, llmResponse string, corrections array<struct<original: string, corrected: string, source: string>>, success boolean"
HOMOPHONE_SCHEMA = "homophones array<struct<words: array<string>, definitions: map<string, string>, examples: map<string, string>>>"
#: Header names of a pair file, in the order of their precedence.
MISSPELLING_ALIASES, CORRECT_ALIASES = ("misspelling", "wrong", "input"), ("correct", "right", "label")


def read_headed_list(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", keep_counts: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, pos (a line's first byte), correct, misspelling, frequency from files of "$head" lines and their members.

    Files are read in ranges of split_bytes; the last head of each range is carried to the next by a
    window over the ranges of a file, of which there are as few as tasks.
    Blank lines and members before the first head are dropped, underscores are blanks,
    members equal to their head but for case are dropped.  A member's trailing count
    becomes its frequency; keep_counts leaves it in the misspelling, as published sets do.
    """
    spark.dataSource.register(HeadedList)
    source = lambda name, value: spark.read.format("headed_list").option("encoding", encoding).option("split_bytes", split_bytes).option(name, value).load(path)
    before = W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = source("parts", "heads").select("path", "range", F.last("head", ignorenulls=True).over(before).alias("_carried"))
    lines = source("carry", "none").join(F.broadcast(carried), ["path", "range"]).withColumn("head", F.coalesce("head", "_carried"))
    return members_of(lines, keep_counts)


def members_of(lines: DataFrame, keep_counts: bool = False) -> DataFrame:
    """The pairs of rows (path, pos, head, line) of the headed_list source."""
    members = lines.filter("head IS NOT NULL").withColumn("correct", F.regexp_replace(F.substring("head", 2, 1 << 30), "_", " "))
    plain = F.regexp_replace("line", "_", " ")
    count = F.regexp_extract(plain, r"\s(\d+)$", 1)
    word = plain if keep_counts else F.when(count != "", F.regexp_replace(plain, r"\s+\d+$", "")).otherwise(plain)
    found = members.select("path", "pos", "correct", word.alias("misspelling"), F.when(count != "", count.cast("int")).alias("frequency"))
    return found.filter(F.lower("misspelling") != F.lower("correct"))


def read_typo_commits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typo commits from (gzipped) JSON lines; malformed lines go, missing keys get defaults."""
    edits = F.transform("edits", lambda e: F.struct(F.coalesce(e["is_typo"], F.lit(False)).alias("is_typo"), F.struct(F.coalesce(e["src"]["text"], F.lit("")).alias("text"), F.coalesce(e["src"]["lang"], F.lit("")).alias("lang")).alias("src"), F.struct(F.coalesce(e["tgt"]["text"], F.lit("")).alias("text")).alias("tgt")))
    return spark.read.schema(TYPO_SCHEMA).json(paths, mode="DROPMALFORMED").select(F.coalesce(edits, F.array()).alias("edits"))


def _pair(rows: DataFrame, misspelling, correct) -> DataFrame:
    m, c = F.lower(strip(F.coalesce(misspelling, F.lit("")))), F.lower(strip(F.coalesce(correct, F.lit(""))))
    return rows.select(m.alias("misspelling"), c.alias("correct")).filter("misspelling <> '' AND correct <> '' AND misspelling <> correct")


def read_pair_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """misspelling, correct from CSV files, each with a header of its own that uses any alias; the first alias that is not empty counts.

    A file's header is its first line: the least line number of its first block.  Values are found by
    their place in the header of their file.  A value does not go on over several lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    headers = lines.filter("_block = 0").groupBy("_file").agg(F.min(F.struct("_at", "value")).alias("_h")).select("_file", F.col("_h._at").alias("_first"), F.regexp_replace("_h.value", "^\ufeff", "").alias("_header"))
    width = headers.agg(F.max(F.size(F.split("_header", ",")))).first()[0] or 1
    columns = ", ".join(f"c{i} string" for i in range(width))
    # A line is parsed once: through a generator, which no later projection is merged with.
    parsed = lambda df, line: df.withColumn("_p", F.explode(F.array(F.from_csv(line, columns))))
    cells = F.array(*[F.coalesce(F.col("_p")[f"c{i}"], F.lit("")) for i in range(width)])
    named = parsed(headers, F.col("_header")).select("_file", "_first", F.transform(cells, lambda x: F.trim(x)).alias("_names"))
    rows = lines.join(named, "_file").filter(~((F.col("_block") == 0) & (F.col("_at") == F.col("_first"))))
    rows = parsed(rows, F.col("value")).select("_names", cells.alias("_cells"))

    def first(aliases: tuple[str, ...]) -> Column:
        of = lambda name: F.get("_cells", F.array_position("_names", name).cast("int") - 1)
        return F.coalesce(*[F.nullif(of(n), F.lit("")) for n in aliases], F.lit(""))

    return _pair(rows, first(MISSPELLING_ALIASES), first(CORRECT_ALIASES))


def read_pair_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """misspelling, correct from the input and output of JSON lines; malformed lines go."""
    rows = spark.read.schema("input string, output string").json(path, mode="DROPMALFORMED")
    return _pair(rows, F.col("input"), F.col("output"))


def read_instructions(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """Instruction rows of JSON lines; blank lines are skipped; strict: a malformed line fails the read."""
    return spark.read.schema(INSTRUCTION_SCHEMA).json(paths, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_json_array(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array."""
    return spark.read.schema(schema).json(paths, multiLine=True)


def read_cases(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """category, case_id, input, expected: cases for evaluation from files that each hold one JSON array; case_id is a case's place in its file, from 0.  Cases without a category have the file's name for one; a corrupt file is empty."""
    kind = "array<struct<category: string, input: string, expected: string>>"
    text = spark.read.text(paths, wholetext=True).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))
    rows = text.select("_file", F.posexplode(F.from_json("value", kind)).alias("case_id", "c"))
    return rows.select(F.coalesce("c.category", "_file").alias("category"), "case_id", "c.input", "c.expected")


def existing(spark: SparkSession, paths: Iterable[str]) -> tuple[list[str], list[str]]:
    """The paths that are there, and those that are missing."""
    there, missing = [], []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        (there if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else missing).append(p)
    return there, missing


def read_existing(spark: SparkSession, paths: Iterable[str], read) -> tuple[DataFrame | None, list[str]]:
    """read(spark, existing paths), or None when there are none; and the paths that are missing.  ingest.ingest_jsonl also counts and keeps what is malformed."""
    there, missing = existing(spark, paths)
    return (read(spark, there) if there else None), missing


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """word, correction of a JSON object file; a corrupt file is empty."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "correction"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log entries of a JSON array file; a corrupt file is empty."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.inline(F.from_json("value", f"array<struct<{LOG_SCHEMA}>>")))


def read_homophones(spark: SparkSession, path: str) -> DataFrame:
    """group, word, members, definition, example: one row for each word of a homophone file."""
    groups = spark.read.schema(HOMOPHONE_SCHEMA).json(path, multiLine=True).select(F.posexplode("homophones").alias("group", "g"))
    rows = groups.select("group", F.explode("g.words").alias("word"), F.col("g.words").alias("members"), "g.definitions", "g.examples")
    return rows.select("group", "word", "members", F.try_element_at("definitions", "word").alias("definition"), F.try_element_at("examples", "word").alias("example"))


def dictionary(spark: SparkSession) -> DataFrame:
    """dict_pos, word of the built-in dictionary, each word at its first position."""
    return spark.createDataFrame([(i, w) for i, w in enumerate(dict.fromkeys(constants.DICTIONARY))], "dict_pos int, word string")


def valid_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in constants.VALID_WORDS], "word string")


def homophones(spark: SparkSession) -> DataFrame:
    """word, members, definition of the built-in groups."""
    return spark.createDataFrame([(w, g, constants.DEFINITIONS.get(w)) for g in constants.HOMOPHONE_GROUPS for w in g], "word string, members array<string>, definition string")
