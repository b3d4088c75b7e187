"""Sources, sinks and operators on small rows."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from quillwork.functions import registry, text
from quillwork.functions.similarity import lcs_bounds, lcs_length
from quillwork.operators import align, correct, datasets, evaluate, homophones, log, marks, ordering, pairs
from quillwork.sources import readers, sinks, versioned


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_headed_list(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes("early 1\n$café\ncafée 1\n\n  CAFÉ 2\n$ice_cream\nise_creem 3\nplain\n".encode("latin-1"))
    got = rows(readers.read_headed_list(spark, str(tmp_path)).select("correct", "misspelling", "frequency"), "correct", "misspelling")
    assert got == [("café", "cafée", 1), ("ice cream", "ise creem", 3), ("ice cream", "plain", None)]
    kept = rows(readers.read_headed_list(spark, str(tmp_path), keep_counts=True).select("misspelling"), "misspelling")
    assert ("ise creem 3",) in kept and ("CAFÉ 2",) in kept


def test_typo_commits(spark, tmp_path):
    edit = lambda typo, lang, a, b: {"is_typo": typo, "src": {"text": a, "lang": lang}, "tgt": {"text": b}}
    lines = [json.dumps({"edits": [edit(True, "eng", "the smal dog", "the small dog"), edit(False, "eng", "bigg", "big"), edit(True, "fra", "chein", "chien"), {"is_typo": True}]}), "{bad", "", json.dumps({})]
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    assert rows(pairs.mine_commits(readers.read_typo_commits(spark, str(tmp_path / "c.jsonl.gz")))) == [("smal", "small")]


def test_pair_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wrong,input,right\n,Teh,\tThe\nTHE,x,the\nfrend,x,friend\n,,x\n")
    assert rows(readers.read_pair_csv(spark, str(tmp_path / "a.csv")), "correct") == [("frend", "friend"), ("teh", "the")]
    (tmp_path / "a.jsonl").write_text('{"input": "Teh", "output": "the"}\n{bad\n\n{"input": "x"}\n')
    assert rows(readers.read_pair_jsonl(spark, str(tmp_path / "a.jsonl"))) == [("teh", "the")]


def test_instruction_files(spark, tmp_path):
    path = tmp_path / "i.jsonl"
    path.write_text('{"instruction": "i", "input": "a", "output": "b"}\n\n')
    assert rows(readers.read_instructions(spark, str(path), strict=True)) == [("i", "a", "b")]
    found, missing = readers.read_existing(spark, [str(path), str(tmp_path / "no")], readers.read_instructions)
    assert found.count() == 1 and missing == [str(tmp_path / "no")]
    assert readers.read_existing(spark, [str(tmp_path / "no")], readers.read_instructions)[0] is None
    path.write_text("{bad\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_instructions(spark, str(path), strict=True).collect()


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"original": "teh", "corrected": "the"}]))
    assert rows(readers.read_json_array(spark, str(tmp_path / "a.json"), "original string, corrected string")) == [("teh", "the")]
    (tmp_path / "cache").write_text('{"teh": "the"}')
    assert rows(readers.read_cache(spark, str(tmp_path / "cache"))) == [("teh", "the")]
    (tmp_path / "cache").write_text("{oops")
    assert rows(readers.read_cache(spark, str(tmp_path / "cache"))) == []
    (tmp_path / "log").write_text(json.dumps([{"timestamp": "2024-01-02T03:04:05Z", "input": "x", "corrections": [{"original": "a", "corrected": "b", "source": "llm"}, {"source": "cache"}], "success": True}]))
    found = readers.read_log(spark, str(tmp_path / "log"))
    assert rows(log.source_counts(found)) == [(2, 0, 1, 1)] and found.select("success").first()[0]
    (tmp_path / "log").write_text("nope")
    assert readers.read_log(spark, str(tmp_path / "log")).count() == 0
    (tmp_path / "h.json").write_text(json.dumps({"homophones": [{"words": ["no", "know"], "definitions": {"no": "not yes"}, "examples": {"know": "I know."}}]}))
    assert rows(readers.read_homophones(spark, str(tmp_path / "h.json")), "word") == [(0, "know", ["no", "know"], None, "I know."), (0, "no", ["no", "know"], "not yes", None)]


def test_constants(spark):
    words = readers.dictionary(spark)
    assert words.count() == 138 and words.agg(F.max("dict_pos")).first()[0] == 137
    assert readers.homophones(spark).count() == 24


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("teh", "the")], "word string, correction string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True)) == [("teh", "the")]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.write_report(df, str(tmp_path / "r"))
    assert json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "r"), wholetext=True).collect())) == [{"word": "teh", "correction": "the"}]
    sinks.write_cache(df, str(tmp_path / "k"))
    assert rows(versioned.read(spark, str(tmp_path / "k"))) == [("teh", "the")]
    sinks.clear(spark, str(tmp_path / "k"))
    assert not (tmp_path / "k").exists()
    assert sinks.export_log(df, str(tmp_path), "2024-01-02").endswith("spelling-log-2024-01-02")


def test_word_typos(spark):
    cases = [("one smal cat", "one small cat", [("smal", "small")]), ("a smal", "small", []), ("ab xyz", "ac xyzwvut", []), ("str foo", "stt fooo", [("foo", "fooo")]), ("apples", "apple", []), ("cats", "cat", [("cats", "cat")]), ("first", "last", [])]
    for a, b, wanted in cases:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(pairs.word_typos("a", "b")).first()[0]
        assert [tuple(x) for x in got] == wanted, (a, b)


def test_precedence(spark):
    first = spark.createDataFrame([("teh", "the"), ("frend", "friend")], "misspelling string, correct string")
    second = spark.createDataFrame([("teh", "the"), ("skool", "school"), ("skool", "school")], "misspelling string, correct string")
    both = pairs.combine_sources([("B", first), ("A", second)])
    assert rows(pairs.keep_first(both, "priority").select("misspelling", "source"), "misspelling") == [("frend", "B"), ("skool", "A"), ("teh", "B")]
    assert [r[:3] for r in rows(pairs.source_statistics(both, "priority"), "source")] == [("A", 3, 1), ("B", 2, 2)]
    again = pairs.keep_first(pairs.keep_first(both, "priority"), "priority")
    assert again.count() == 3


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11])
def test_exact_split(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    got = ordering.shuffled_split(df, 0.9)
    assert got.filter("split = 'train'").count() == int(n * 0.9)
    assert sorted(r["row_number"] for r in got.collect()) == list(range(1, n + 1))


def test_row_numbers_over_many_partitions(spark):
    df = spark.range(5000).repartition(7).select((F.col("id") * 7 % 5000).alias("k"))
    assert ordering.with_row_number(df, "k").filter("row_number <> k + 1").count() == 0


def test_training_rows(spark):
    df = spark.createDataFrame([("teh", "the"), ("frend", "friend")], "misspelling string, correct string")
    assert rows(datasets.word_rows(df))[0] == ("Fix the spelling of this word.", "teh", "the")
    assert rows(datasets.changes_rows(df, "have"))[0][1:] == ('Fix spelling: "I have teh here."', "CHANGES: teh->the")
    assert [r[2:] for r in rows(datasets.sentence_rows(df, "correct"), "row_number")] == [("I have frend food.", "I have friend food."), ("The teh is big.", "The the is big.")]
    chat = datasets.chat_rows(datasets.word_rows(df)).first()["messages"]
    assert [m["role"] for m in chat] == ["system", "user", "assistant"] and chat[1]["content"] == "Fix the spelling of this word.\n\nteh"
    assert datasets.corrected_sentence_rows(spark.createDataFrame([("a", "b")], "original string, corrected string")).first()["output"] == "b"


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [
        ("I lik cats", "I like cats", [("lik", "like")]),
        ("I like cats", "I like cats", []),
        ("My freind Jon ran hoem fast", "My friend Jon just ran home fast", [("freind", "friend"), ("hoem", "home")]),
        ("one two", "one two three four five six", []),
        ("Teh dog", "Here's the corrected sentence: The dog", [("Teh", "The")]),
        ("abcd", "abce abcf", [("abcd", "abce")]),
        ("", "", []),
    ],
)
def test_sentence_changes(spark, a, b, wanted):
    df = spark.createDataFrame([(1, a, b), (2, None, b), (3, a, None)], "k int, a string, b string")
    got = align.sentence_changes(df, "k", original="a", corrected="b").orderBy("i").collect()
    assert [(r["original"], r["corrected"]) for r in got] == wanted and all(r["k"] == 1 for r in got)


def test_matches_by_sound(spark):
    words = spark.createDataFrame([("becuase",), ("freind",), ("zzz",), ("im",)], "word string")
    got = {r["word"]: r for r in correct.phonetic_matches(words, readers.dictionary(spark)).collect()}
    assert got["becuase"]["best_match"] == "because" and got["freind"]["best_match"] == "friend" and "zzz" not in got
    scores = correct.scored(correct.phonetic_candidates(words, correct.phonetic_index(readers.dictionary(spark))))
    ranked = {r["word"]: r["candidates"] for r in correct.ranked_candidates(scores, "word", "code_rank", "dict_pos").collect()}
    assert all(ranked[w][0] == r["candidate"] for w, r in got.items()) and ranked.keys() == got.keys()
    assert got["im"]["candidate"] == "i'm" and got["im"]["score"] == pytest.approx(0.7333, abs=1e-3)


def test_close_alternatives_and_ties(spark):
    scores = spark.createDataFrame([("w", "b", 0.9, 1), ("w", "a", 0.9, 2), ("v", "x", 0.4, 0), ("v", "y", 0.39, 1), ("u", "x", 0.8, 0)], "word string, candidate string, score double, pos int")
    got = {r["word"]: r for r in correct.best_matches(scores, "word", "pos").collect()}
    assert got["w"]["best_match"] == "b" and got["w"]["confidence"] == pytest.approx(0.63)
    assert got["v"]["best_match"] is None and got["u"]["confidence"] == 0.8


def test_hybrid_check(spark):
    asked = spark.createDataFrame([("1", "My freind is qwxyz teh  becuase"), ("2", ""), ("3", "the cat")], "key string, sentence string")
    cache = spark.createDataFrame([("teh", "the")], "word string, correction string")
    model = correct.lookup_corrector(spark.createDataFrame([("My freind is qwxyz teh  becuase", "My friend is quiz the because")], "sentence string, reply string"))
    got = {r["key"]: [tuple(c) for c in r["corrections"]] for r in correct.check_sentences(asked, readers.dictionary(spark), cache, model).collect()}
    assert got["1"] == [(3, "freind", "friend", "phonetic"), (19, "teh", "the", "cache"), (24, "becuase", "because", "phonetic"), (13, "qwxyz", "quiz", "llm")]
    assert got["2"] == []
    plain = correct.check_sentences(asked, readers.dictionary(spark)).filter("key = '1'").first()["corrections"]
    assert [c["original"] for c in plain] == ["freind", "becuase"]


def test_places_of_model_changes_in_any_script(spark):
    # Latin letters are found by place, others by a pattern: İ is two letters when lower-cased, the long s is an s.
    texts = {"1": "Éß QWXYZ zzqqk", "2": "İİ qwxyz zzqqk", "3": "quiz zzkkq qwxyz"}
    asked = spark.createDataFrame(list(texts.items()), "key string, sentence string")
    replies = spark.createDataFrame([(t, t.replace("QWXYZ", "QWXYA").replace("qwxyz", "qwxya")) for t in texts.values()], "sentence string, reply string")
    found = correct.check_sentences(asked, readers.dictionary(spark), None, correct.lookup_corrector(replies)).collect()
    assert {r["key"]: [(c[0], c[1], c[2]) for c in r["corrections"] if c[3] == "llm"] for r in found} == {"1": [(3, "QWXYZ", "QWXYA")], "2": [(3, "qwxyz", "qwxya")], "3": [(11, "qwxyz", "qwxya")]}


def test_places_are_summed_once(spark):
    asked = spark.createDataFrame([("1", "My freind is qwxyz teh  becuase")], "key string, sentence string")
    plan = correct.check_sentences(asked, readers.dictionary(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sums_before(") == 1


def test_rewrite(spark):
    asked = spark.createDataFrame([("1", "(teh) frend, x"), ("2", "teh wrod"), ("3", "fine")], "key string, sentence string")
    cache = spark.createDataFrame([("teh", "the"), ("frend", "friend")], "word string, correction string")
    replies = spark.createDataFrame([("1", "CHANGES: x->y"), ("2", "CHANGES: wrod->word")], "key string, reply string")
    got = {r["key"]: (r["corrected"], r["cache_hits"], r["asked"]) for r in correct.rewrite_sentences(asked, cache, replies).collect()}
    assert got == {"1": ("the() friend, x", 2, False), "2": ("the word", 1, True), "3": ("fine", 0, True)}


def test_dictionary_and_cache(spark):
    new = spark.createDataFrame([("Zebra",), ("want",), ("zebra",)], "word string")
    got = correct.add_words(readers.dictionary(spark), new)
    assert got.count() == 139 and got.filter("word = 'zebra'").first()["dict_pos"] == 138
    writes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "word string, correction string, at int")
    assert rows(correct.latest(writes, "at")) == [("a", "y")]


def test_homophones(spark):
    asked = spark.createDataFrame([("1", "They're here, by 'their' desk")], "key string, sentence string")
    assert [r[3] for r in rows(homophones.scan(asked, readers.homophones(spark)), "index")][:3] == ["they're", "here", "by"]
    assert [r[3] for r in rows(homophones.scan(asked, readers.homophones(spark), keep_apostrophes=False), "index")] == ["here", "by", "their"]
    script = asked.select(homophones.speech_script("sentence", F.lit("by"), F.lit("buy"), F.lit("near"), F.lit(None).cast("string"))).first()[0]
    assert "[pause] BY. BY means near. Did you mean BUY, as in unknown?" in script


def test_marks(spark):
    texts = spark.createDataFrame([("1", "Teh cat, teh TEH ateh teh."), ("2", "teh's do'nt teh")], "key string, text string")
    fixes = spark.createDataFrame([("1", "teh", "the"), ("2", "teh", "the"), ("2", "Do'nt", "don't"), ("2", "", "x")], "key string, original string, corrected string")
    got = marks.mark_occurrences(texts, fixes).select("key", "from", "to", "correction")
    assert rows(got, "key", "from") == [("1", 0, 3, "the"), ("1", 9, 12, "the"), ("1", 13, 16, "THE"), ("1", 22, 25, "the"), ("2", 0, 3, "the"), ("2", 6, 11, "don't"), ("2", 12, 15, "the")]
    t = texts.filter("key = '1'").select(marks.accept_correction(F.col("text"), F.lit(9), F.lit(12), F.lit("the"))).first()[0]
    assert t == "Teh cat, the TEH ateh teh."
    listed = spark.createDataFrame([([("Teh", "the"), ("x", "y")],)], "c array<struct<original: string, corrected: string>>")
    assert listed.select(marks.suggestion_for(F.lit("TEH"), F.col("c"))).first()[0] == "the"
    assert len(listed.select(marks.remaining_corrections(F.col("c"), F.lit("teh"))).first()[0]) == 1


def test_evaluation(spark):
    cases = spark.createDataFrame([("pass_through", 1, "I am", "I am"), ("word_preservation", 1, "a b c", "a b c"), ("corrections", 1, "teh", "the")], "category string, case_id int, input string, expected string")
    outputs = spark.createDataFrame([("m", "pass_through", 1, "<think>no</think>I am", 1.0), ("m", "word_preservation", 1, "a", 2.0), ("m", "corrections", 1, "the", 3.0)], "model string, category string, case_id int, output string, time double")
    scored = evaluate.score_sentences(cases, outputs)
    assert rows(evaluate.suite_summary(scored).select("category", "n_passed", "n_failed"), F.col("category").asc_nulls_first()) == [(None, 2, 1), ("corrections", 1, 0), ("pass_through", 1, 0), ("word_preservation", 0, 1)]
    words = evaluate.score_words(spark.createDataFrame([(1, "teh", "the")], "case_id int, input string, expected string"), spark.createDataFrame([("m", 1, "The end", 1.0), ("n", 1, "", 2.0)], "model string, case_id int, output string, time double"))
    summary = evaluate.accuracy(words)
    assert evaluate.best_model(summary).first()[0] == "m" and evaluate.best_balance(summary).first()["balance"] == 95.0
    assert evaluate.failures(scored, "case_id").count() == 1


def test_log(spark):
    assert log.last_entries(spark.range(250), "id").agg(F.min("id"), F.count("id")).first() == (150, 100)


def test_orders_of_reports(spark):
    """Statistics come in the order that they are read in."""
    df = spark.createDataFrame([("s1", 0, "a", "b"), ("s2", 1, "a", "b"), ("s2", 1, "abc", "x"), ("s2", 1, "ab", "abcd")], "source string, priority int, misspelling string, correct string")
    assert [r["source"] for r in pairs.source_statistics(df, "priority").collect()] == ["s2", "s1"]
    assert [r["edit_distance"] for r in pairs.distance_histogram(df).collect()] == [1, 2, 3]
    assert [r["edit_distance"] for r in pairs.distance_histogram(df, first=2).collect()] == [1, 2]
    judged = spark.createDataFrame([("n", "b", False), ("m", "a", True), ("m", "b", False), ("k", "a", True)], "model string, category string, correct boolean").withColumn("time", F.lit(1.0)).withColumn("passed", F.col("correct"))
    assert [r["model"] for r in evaluate.accuracy(judged).collect()] == ["k", "m", "n"]
    assert [(r["model"], r["category"]) for r in evaluate.suite_summary(judged).collect()] == [("k", None), ("k", "a"), ("m", None), ("m", "a"), ("m", "b"), ("n", None), ("n", "b")]
    assert rows(df.filter(pairs.differs(F.col("misspelling"), F.lit("A"))).select("misspelling"), "misspelling") == [("ab",), ("abc",)]


def test_functions_in_sql(spark):
    registry.register(spark)
    got = spark.sql("SELECT double_metaphone('night') AS m, lcs_length('becuase', 'because') AS l, matching_ratio('abcd', 'bcde') AS r").first()
    assert got["m"][0] == "NT" and got["l"] == 6 and got["r"] == 0.75


def test_bounds_of_the_common_subsequence(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
    df = spark.createDataFrame([(word(), word()) for _ in range(500)], "a string, b string")
    least, most = lcs_bounds(F.col("a"), F.col("b"))
    assert df.filter((lcs_length("a", "b") < least) | (lcs_length("a", "b") > most)).count() == 0


def test_contenders_keep_the_best_two(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 7)))
    df = spark.createDataFrame(sorted({(rng.choice(["abcd", "dcba", "aabb"]), word()) for _ in range(400)}), "word string, candidate string")
    whole, cut = (sorted(map(tuple, correct.best_matches(correct.scored(c, "word")).collect())) for c in (df, correct.contenders(df, word="word")))
    assert whole == cut and len(whole) == 3
    assert correct.contenders(df, word="word").count() < df.count()


def test_cases_and_clock(spark, tmp_path):
    (tmp_path / "edge_cases.json").write_text(json.dumps([{"input": "teh", "expected": "the"}, {"category": "dyslexia", "input": "dog", "expected": "bog"}]))
    (tmp_path / "broken.json").write_text("[{")
    got = rows(readers.read_cases(spark, str(tmp_path)), "case_id")
    assert got == [("edge_cases", 0, "teh", "the"), ("dyslexia", 1, "dog", "bog")]
    entries = spark.createDataFrame([(10,), (None,)], "s long").select(F.timestamp_seconds("s").alias("timestamp"))
    aged = log.with_elapsed(entries, now=F.timestamp_seconds(F.lit(12.5))).select("age_seconds").collect()
    assert sorted(r[0] or -1 for r in aged) == [-1, 2.5]
    assert log.with_elapsed(entries).filter("age_seconds > 0").count() == 1
    path = sinks.export_log(spark.range(2), f"file://{tmp_path}/logs")
    assert path.endswith(spark.sql("SELECT date_format(now(), 'yyyy-MM-dd')").first()[0]) and spark.read.json(path).count() == 2


def test_speech_of_all_homophones(spark):
    df = spark.createDataFrame([("Go BY, their way no", ), (None,), ("",)], "s string")
    got = [r[0] for r in df.select(homophones.speech_scripts("s", [["by", "buy"], ["their", "there", "they're"], ["alone"]], {"by": "near", "there": "that place"})).collect()]
    assert got == ["Go [pause] BY,. BY means near. Did you mean BUY, as in unknown? [pause] THEIR. THEIR means unknown. Did you mean THERE, as in that place? way no", None, ""]


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": None},), ({},), (None,)], "m map<string, int>")
    one = df.select(text.map_get(F.col("m"), F.lit("a"), F.lit(0)), text.map_get(F.col("m"), F.lit("b"), F.lit(7)), text.map_put(F.col("m"), F.lit("a"), F.lit(5)), text.map_delete(F.col("m"), F.lit("a"))).collect()
    assert [tuple(r) for r in one] == [(1, 7, {"b": None, "a": 5}, {"b": None}), (0, 7, {"a": 5}, {}), (0, 7, None, None)]


def test_training_set(spark, tmp_path):
    rows_of = lambda n, k: spark.createDataFrame([("i", f"{n}{j}", "o") for j in range(k)], "instruction string, input string, output string")
    found = datasets.training_set([("a", rows_of("x", 13)), ("b", rows_of("y", 7)), ("c", rows_of("x", 0))])
    datasets.write_training_set(found, str(tmp_path / "set"))
    got = {s: spark.read.json(f"{tmp_path}/set/{s}").collect() for s in ("train", "eval")}
    assert {s: len(g) for s, g in got.items()} == {"train": 18, "eval": 2}
    wanted = {r["row_number"]: r["input"] for r in found.collect()}
    assert [r["messages"][1]["content"] for r in got["eval"]] == [f"i\n\n{wanted[n]}" for n in (19, 20)]


def test_rows_that_share_a_key(spark):
    """Sentences of one key do not mix; null keys keep their words; repeated rows stay."""
    rows_ = [("k", "teh cat."), ("k", "Onth of"), (None, "teh end"), (None, None), ("k", "teh cat.")]
    sentences = spark.createDataFrame(rows_, "key string, sentence string")
    cache = spark.createDataFrame([("teh", "the"), ("onth", "month")], "word string, correction string")
    got = sorted((str(r["key"]), str(r["corrected"]), r["cache_hits"]) for r in correct.rewrite_sentences(sentences, cache).collect())
    assert got == [("None", "None", 0), ("None", "the end", 1), ("k", "month of", 1), ("k", "the cat.", 1), ("k", "the cat.", 1)]
