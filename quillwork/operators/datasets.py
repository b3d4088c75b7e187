"""Training rows: instructions, chat messages, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.ordering import shuffled_split, with_row_number
from quillwork.sources import constants as C


def _rows(instruction: str, given: Column, wanted: Column) -> list[Column]:
    return [F.lit(instruction).alias("instruction"), given.alias("input"), wanted.alias("output")]


def word_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(*_rows(C.WORD_INSTRUCTION, F.col("misspelling"), F.col("correct")))


def changes_rows(pairs: DataFrame, template: str = "the") -> DataFrame:
    """template: "have" or "the", the two sentences in use."""
    before, after = C.CHANGES_TEMPLATES[template].split("{}")
    return pairs.select(*_rows(C.CHANGES_INSTRUCTION, F.concat(F.lit(before), "misspelling", F.lit(after)), F.concat(F.lit("CHANGES: "), "misspelling", F.lit("->"), "correct")))


def sentence_rows(pairs: DataFrame, *order: str) -> DataFrame:
    """Sentences from templates in turn, by the row's place in the order; row_number from 1."""
    numbered = with_row_number(pairs, *order)
    template = F.element_at(F.array(*map(F.lit, C.SENTENCE_TEMPLATES)), (F.pmod(F.col("row_number") - 1, F.lit(len(C.SENTENCE_TEMPLATES))) + 1).cast("int"))
    fill = lambda word: F.replace(template, F.lit("{}"), F.col(word))
    return numbered.select("row_number", *_rows(C.SENTENCE_INSTRUCTION, fill("misspelling"), fill("correct")))


def corrected_sentence_rows(pairs: DataFrame) -> DataFrame:
    """Instruction rows of sentence pairs original, corrected."""
    return pairs.select(*_rows(C.SENTENCE_INSTRUCTION, F.col("original"), F.col("corrected")))


def chat_messages(system: str = C.CHAT_SYSTEM) -> Column:
    """Array of role and content: system, user (instruction, blank line, input) and assistant."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("system", F.lit(system)), said("user", F.concat("instruction", F.lit("\n\n"), "input")), said("assistant", F.col("output")))


def chat_rows(instructions: DataFrame, system: str = C.CHAT_SYSTEM) -> DataFrame:
    return instructions.select(chat_messages(system).alias("messages"))


def prompt_text() -> Column:
    """The prompt for models without a chat template."""
    return F.concat(F.lit("### Instruction:\n"), "instruction", F.lit("\n\n### Input:\n"), "input", F.lit("\n\n### Response:\n"), "output")


def training_set(sources: list[tuple[str, DataFrame]], share: float = 0.9, system: str = C.CHAT_SYSTEM) -> DataFrame:
    """source, instruction, input, output, row_number, split, messages: instruction rows of named sources as one set, in a seeded order, cut into train and eval; repeated rows stay."""
    union = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("source"), "instruction", "input", "output") for name, df in sources])
    return shuffled_split(union, share).withColumn("messages", chat_messages(system))


def write_training_set(rows: DataFrame, folder: str) -> None:
    """Two sets of JSON lines of messages, train and eval, each in the order of its rows."""
    for split in ("train", "eval"):
        part = rows.filter(F.col("split") == split)
        part.repartitionByRange("row_number").sortWithinPartitions("row_number").select("messages").write.mode("overwrite").json(f"{folder}/{split}")
