"""How far sources of a language are from each other, by the terms that they use.

Terms are counted by source with partial sums where the texts lie.  Then each term of a
language is one row: a wide vector, an array with a place for every source of the
language.  Terms of equal vectors add the same, so each vector is worked out once and
counts as often as it occurs.  Higher-order functions turn the counts of a vector into
shares and emit, for each of its sources, an array of what it adds to the pairs with
all others; the additions are summed up in the tasks before they are moved.  A term that two
sources both lack adds the same to their pair whatever the term is, so only pairs
that have it in one source at least are emitted, and the others are added as one product.

All arithmetic is of whole numbers.  A share is 1 + floor(10^9 (count + 1) / (N + V)), N
the counts of the V kept terms in the source (or in the language), and what a
source with share p is from one with share q is floor((p - q)^2 / q).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.llm._common import write_scratch
from quillwork.operators.align import once

#: What stands in terms as it is, besides all beyond ASCII; A-Z become these, other ASCII characters part terms.
LETTERS = string.ascii_lowercase
_PARTING = "".join(c for c in map(chr, range(128)) if c not in string.ascii_letters)
SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)); in decimals, for the product may be beyond a long."""
    wide = lambda x: x.cast("decimal(20,0)")
    return 1 + _div(F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + kept))


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it): nulls are empty texts; only A-Z are lower-cased."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parted = F.translate(part(text_col), string.ascii_uppercase + _PARTING, LETTERS + " " * len(_PARTING))
    rows = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), F.split(parted, " ").alias("_t"))
    # All terms of a row, and behind them the different ones.
    each = rows.select("lang", "source", F.size("_t").alias("_many"), F.posexplode(F.concat("_t", F.array_distinct("_t"))).alias("_i", "term")).filter("term <> ''")
    is_term = F.col("_i") < F.col("_many")
    return each.groupBy("lang", "source", "term").agg(F.count_if(is_term).alias("n"), F.count_if(~is_term).alias("docs"))


def wide_vectors(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, counts (by source, those above zero): the terms that so many documents of the language hold."""
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return rows.filter(F.col("_docs") >= min_docs).drop("_docs")


def language_totals(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, kept (terms), total, sources: (source, n, zero) in order of the source; every language and source of groups, n the counts of its kept terms, zero its share of a term that it lacks."""
    n = vectors.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    told = groups.join(n, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = told.groupBy("lang").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"))
    known = each.join(v, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), "total", "sources")
    zero = lambda s: F.when(F.col("kept") > 0, share(F.lit(0), s["n"], F.col("kept")))
    return known.withColumn("sources", F.transform("sources", lambda s: F.struct(s["source"].alias("source"), s["n"].alias("n"), zero(s).alias("zero"))))


def _pairs(vectors: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value: every source and every other one of its language."""

    alike = vectors.groupBy("lang", "_c").agg(F.count(F.lit(1)).alias("_m"), F.any_value("_p").alias("_p"))
    # Little data but much work: as many tasks as a shuffle has.
    alike = alike.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = alike.select("lang", "_m", "_c", "_p", F.posexplode(F.arrays_zip("_c", "_p")).alias("i", "_a"))
    held, p = F.col("_a._c") > 0, F.col("_a._p")
    added = F.when(held, F.transform("_p", lambda q: distance(p, q))).otherwise(F.zip_with("_c", "_p", lambda c, q: F.when(c > 0, distance(p, q))))
    each = one.select("lang", "_m", "i", F.posexplode(added).alias("j", "f")).filter("f IS NOT NULL")
    sums = each.groupBy("lang", "i", "j").agg(F.sum(F.col("f") * F.col("_m")).alias("_f"), F.sum("_m").alias("_n"))
    one = totals.select("lang", "kept", "sources", F.posexplode("sources").alias("i", "a"))
    two = one.select("lang", "kept", "i", "a", F.posexplode("sources").alias("j", "b")).filter("i <> j")
    met = two.join(sums, ["lang", "i", "j"], "left")
    lacking = F.coalesce(distance(F.col("a.zero"), F.col("b.zero")), F.lit(0))
    value = F.coalesce("_f", F.lit(0)) + (F.col("kept") - F.coalesce("_n", F.lit(0))) * lacking
    return met.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), value.alias("value"))


def _terms(vectors: DataFrame) -> DataFrame:
    """lang, source, item, value: the terms of a source that it uses more than its language."""
    used = F.filter(F.arrays_zip(F.col("_s").alias("source"), F.col("_c").alias("c"), F.col("_p").alias("p")), lambda x: (x["c"] > 0) & (x["p"] > F.col("_q")))
    return vectors.select("lang", F.col("term").alias("item"), "_q", F.inline(used)).select("lang", "source", "item", distance(F.col("p"), F.col("_q")).alias("value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    part pair: item is another source of the language, value the sum over all kept terms, all
    of them ranked.  part term: item is a kept term that the source holds and has a greater
    share of than its language, ranked to `top`.  Ranks count from 1 in each source
    and part, the greatest value first, then the item's UTF-8 bytes.

    A term is kept in a language if at least min_docs of its rows hold it; repeated rows count
    as often as they come.  Null languages, sources and texts are empty texts; a source
    without a term takes part with counts of zero, and pairs of a language without kept
    terms have the value 0.  A language of one source has no pairs.  An empty
    table gives an empty result; columns other than the three named are not read.
    What is held for a language is a number for each of its sources, as the result is for each pair.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source")).distinct()
    kept = write_scratch(wide_vectors(term_counts(docs, lang_col, source_col, text_col), min_docs), "divergence-vectors")
    totals = write_scratch(language_totals(groups, kept), "divergence-totals")

    rows = kept.join(totals, "lang")
    named = once(rows, "lang", "term", "kept", "total", "sources", _c=F.transform("sources", lambda s: F.coalesce(F.try_element_at("counts", s["source"]), F.lit(0))))
    shares = F.zip_with("_c", "sources", lambda c, s: F.when(c == 0, s["zero"]).otherwise(share(c, s["n"], F.col("kept"))))
    all_of = F.aggregate("_c", F.lit(0).cast("long"), lambda acc, c: acc + c)
    vectors = once(named, "lang", "term", "_c", _s=F.transform("sources", lambda s: s["source"]), _p=shares, _q=share(all_of, F.col("total"), F.col("kept")))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by))
    columns = lambda name: ["lang", "source", F.lit(name).alias("part"), "item", "value", "rank"]
    return ranked(_pairs(vectors, totals)).select(*columns("pair")).unionByName(ranked(_terms(vectors)).filter(F.col("rank") <= top).select(*columns("term")))
