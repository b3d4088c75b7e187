"""Queries over all turns and their whole texts, against plain Python."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillwork.functions.phonetic import metaphone_codes
from quillwork.operators.align import sentence_changes
from quillwork.plans import catalogue
from quillwork.sources import constants as C

NOISE = str.maketrans(*catalogue.SWAP)
SPACE = r"[ \t\n\x0b\f\r]+"


@pytest.fixture(scope="module")
def turns(sf_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    assert any(not t.isascii() for *_, t in rows) and any(len(t.split()) > 12 for *_, t in rows)
    return rows


def words(text):
    return [w for w in re.split(SPACE, text) if w]


def got(spark, sf_dir, name, *columns):
    return Counter(tuple(r) for r in catalogue.queries()[name](spark, sf_dir).select(*columns).collect())


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    return 1.0 if a == b else 1 - levenshtein(a, b) / max(len(a), len(b))


def ends(w):
    return re.sub(r"^[^a-zA-Z0-9_']+|[^a-zA-Z0-9_']+$", "", w).lower()


def changes(original, corrected):
    corrected = re.sub(r"^(here'?s?\s+(the\s+)?corrected\s+(sentence|text)[:\s]*)", "", corrected, flags=re.I | re.A)
    corrected = re.sub(r"^(corrected[:\s]*)", "", corrected, flags=re.I | re.A).strip()
    a, b = re.split(SPACE, original), [ends(w) for w in re.split(SPACE, corrected)]
    if abs(len(a) - len(b)) > 3:
        return
    for i, w in enumerate(a):
        c, shown = ends(w), re.search("[a-zA-Z',]+", w)
        if len(c) < 2 or c in C.VALID_WORDS or not shown:
            continue
        best, score = None, 0.0
        for j in range(max(i - 2, 0), min(i + 3, len(b))):
            s = similarity(c, b[j]) if b[j] else 0.0
            if s > 0.3 and s + (0.1 if i == j else 0.0) > score:
                best, score = b[j], s + (0.1 if i == j else 0.0)
        if best and best != c:
            o = shown[0]
            yield o, best.upper() if o == o.upper() else best[0].upper() + best[1:] if o[0] == o[0].upper() else best


def test_sentence_diff(spark, sf_dir, turns):
    wanted = Counter()
    for conv, turn, text in turns:
        w = words(text)
        for o, c in changes(" ".join(w).translate(NOISE), " ".join(w[:3] + w[4:])):
            wanted[conv, turn, o, c] += 1
    assert got(spark, sf_dir, "sentence_diff", "conv_id", "turn", "original", "corrected", "n") == Counter((*k, n) for k, n in wanted.items())


def test_changes_beside_equal_words(spark):
    """Equal words beside a place win unless a long word in it is nearly equal."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        base = ["".join(rng.choices("abc", k=rng.randint(2, 14))) for _ in range(3)]
        near = [w[:-1] + x for w in base for x in "abc"]
        rows.append((k, " ".join(rng.choices(base + near, k=8)), " ".join(rng.choices(base + near, k=rng.randint(6, 10)))))
    found = sentence_changes(spark.createDataFrame(rows, "k int, original string, corrected string"), "k").select("k", F.col("original"), F.col("corrected"))
    assert Counter(map(tuple, found.collect())) == Counter((k, o, c) for k, a, b in rows for o, c in changes(a, b))


def test_sentence_diff_of_sharp_s_equals_sql(spark, tmp_path):
    texts = ["Schge enge iegeung SSßpf zukeitein chver", "Süß Fuß Maß Füßé die groß und bßße", "SSßbe das ungscher lichie üst", "ŉb ŉbb ŉbd ŉpp ŉpd B'"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ("conv_id", "turn", "original", "corrected", "n")
    wanted = Counter(db.sql(catalogue.oracle_sql()["sentence_diff"]).select(*columns).fetchall())
    assert any("ẞ" in r[3] for r in wanted)
    assert got(spark, str(tmp_path), "sentence_diff", *columns) == wanted


def test_reply_cleaning(spark, sf_dir, turns):
    wanted = Counter()
    for conv, turn, text in turns:
        once = re.sub(r"^(here'?s?\s+(the\s+)?corrected\s+(sentence|text)[:\s]*)", "", "Here's the corrected sentence: " + text, flags=re.I | re.A)
        sentence = re.sub(r"^(corrected[:\s]*)", "", once, flags=re.I | re.A).strip()
        answer = (text + "\nmore").strip().split("\n")[0].strip()
        first = re.search(r"[^ \t\n\x0b\f\r]+", (text + "\nlines").strip().split("\n")[0])
        hinted = re.search(r'"([a-zA-Z0-9_\']+)"', f'HINT: "{(words(text) or [""])[0]}" means {text}')
        wanted[conv, turn, sentence, answer, first[0], hinted[1] if hinted else "", True] += 1
    assert got(spark, sf_dir, "reply_cleaning", "conv_id", "turn", "sentence", "answer", "word", "hinted", "is_hint") == wanted


def case(shown, c):
    return c.upper() if shown == shown.upper() else c.lower() if shown == shown.lower() else c


def test_apply_cache(spark, sf_dir, turns):
    cache, wanted = dict(catalogue.CACHE), Counter()
    for conv, turn, text in turns:
        found = [(w, cache.get(re.sub(r"\W", "", w).lower())) for w in words(text)]
        n = sum(c is not None for _, c in found)
        joined = " ".join(w if c is None else c + re.sub(r"\w", "", w) for w, c in found)
        wanted[conv, turn, n, joined if n else text, n < 2] += 1
    assert got(spark, sf_dir, "apply_cache", "conv_id", "turn", "cache_hits", "corrected", "asked") == wanted


def test_tts_script(spark, sf_dir, turns):
    ask = lambda w: f"[pause] {w.upper()}. BY means {C.DEFINITIONS['by']}. Did you mean BUY, as in {C.DEFINITIONS['buy']}?"
    wanted = Counter((conv, turn, " ".join(ask(w) if re.sub(r"[^\w']", "", w).lower() == "by" else w for w in words(text))) for conv, turn, text in turns)
    assert got(spark, sf_dir, "tts_script", "conv_id", "turn", "script") == wanted


def test_mark_occurrences(spark, sf_dir, turns):
    wanted = Counter()
    for conv, turn, text in turns:
        for o, c in catalogue.CACHE:
            for m in re.finditer(re.escape(o), text, re.I | re.A):
                if not re.match(r"\w", text[m.start() - 1 : m.start()] if m.start() else "", re.A) and not re.match(r"\w", text[m.end() : m.end() + 1], re.A):
                    wanted[conv, turn, m.start(), m.end(), m[0], case(m[0], c)] += 1
    assert got(spark, sf_dir, "mark_occurrences", "conv_id", "turn", "start", "stop", "shown", "correction") == wanted


def test_changes_accepted_and_predicates(spark, sf_dir, turns):
    changed, accepted, passed = Counter(), Counter(), Counter()
    for conv, turn, text in turns:
        one = text
        for o, c in (("the", "teh"), ("on", "no")):
            one = re.sub(o, c, one, count=1, flags=re.I | re.A)
        changed[conv, turn, one] += 1
        accepted[conv, turn, "FIRST" + (text[text.find(" ") :] if " " in text else "")] += 1
        w = words(text)
        reply = " ".join(w[1:])
        passed[conv, turn, reply.lower() in text.lower(), text.strip() == reply.strip(), len(w) - len(words(reply)) <= 1] += 1
    assert got(spark, sf_dir, "apply_changes", "conv_id", "turn", "changed") == changed
    assert got(spark, sf_dir, "accept_correction", "conv_id", "turn", "accepted") == accepted
    assert got(spark, sf_dir, "pass_predicates", "conv_id", "turn", "has_reply", "same", "kept_words") == passed


def test_hybrid_check_of_equal_keys(spark, sf_dir, tmp_path):
    """Turns that share conv_id and turn, and turns without a conv_id, are all checked; equal rows once."""
    rows = [(1, 1, "teh one"), (1, 1, "onth two"), (1, 1, "teh one"), (None, 1, "thon"), (None, 1, "erth"), (None, 2, None), (2, 1, "thon")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalogue.queries()["hybrid_check"](spark, str(tmp_path)).filter("source = 'cache'").collect()
    assert sorted(r["original"] for r in found) == ["erth", "onth", "teh", "thon", "thon"]
    assert len({r["key"] for r in found}) == 5


def metaphone(words):
    return {w: [c for c in dict.fromkeys(metaphone_codes(w)) if c] for w in words}


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def blended(a, b):
    far = max(len(a), len(b))
    return (1 - abs(len(a) - len(b)) / far) * 0.1 + (1.0 if a[0] == b[0] else 0.5) * 0.2 + subsequence(a, b) / far * 0.3 + (1 - levenshtein(a, b) / far) * 0.4


@pytest.fixture(scope="module")
def known(sf_dir):
    """The dictionary with its places: the built-in words, then those of the benchmark by the alphabet."""
    (text,) = duckdb.sql(f"SELECT string_agg(lower(text), ' ') FROM '{sf_dir}/benchmark.parquet'").fetchall()[0]
    first = list(dict.fromkeys(C.DICTIONARY))
    more = {w for w in re.findall(r"\w+", text) if re.fullmatch("[a-z]+", w)} - set(first)
    return {w: i for i, w in enumerate([*first, *sorted(more)])}


def by_sound(word, known, codes, own):
    """Candidates best first, with their scores: every word of the dictionary is looked at."""
    found = []
    for other, place in known.items():
        shared = [r for r, c in enumerate(own[word]) if c in codes[other]]
        if shared and other != word:
            found.append((-blended(word, other), min(shared), place, other))
    return [(o, -s) for s, _, _, o in sorted(found)]


def confidence(found):
    return found[0][1] * 0.7 if len(found) > 1 and found[1][1] > found[0][1] * 0.8 else found[0][1]


def test_phonetic_index_and_match(spark, sf_dir, known):
    (text,) = duckdb.sql(f"SELECT string_agg(lower(text), ' ') FROM '{sf_dir}/documents.parquet'").fetchall()[0]
    added = sorted({w for w in re.findall(r"\w+", text) if re.fullmatch("[a-z]+", w)} - set(known))
    index = {}
    for w, cs in metaphone([*known, *added]).items():
        for c in cs:
            index.setdefault(c, []).append(w)
    order = {w: i for i, w in enumerate([*known, *added])}
    wanted = {c: (len(ws), min(ws, key=order.get)) for c, ws in index.items()}
    assert {r["code"]: (r["n_words"], r["first_word"]) for r in catalogue.queries()["phonetic_index"](spark, sf_dir).collect()} == wanted
    rows = {r["word"]: r for r in catalogue.queries()["phonetic_match"](spark, sf_dir).collect()}
    unknown = [r["word"] for r in catalogue.queries()["unknown_words"](spark, sf_dir).select("word").collect()]
    codes, own, seen = metaphone(known), metaphone(unknown), 0
    for word in unknown:
        found = by_sound(word, known, codes, own)
        assert (word in rows) == bool(found)
        if found:
            sure = confidence(found)
            want = found[0][0] if sure > 0.3 else None
            assert (rows[word]["best_match"], rows[word]["n_candidates"]) == (want, len(found)) and rows[word]["confidence"] == pytest.approx(sure, abs=1e-8)
            seen += 1
    assert seen == len(rows) > 500


def check(text, known, codes):
    """Corrections of one sentence, and whether the model is asked."""
    at, found, ask = 0, [], False
    for token in re.findall(rf"{SPACE}|[^ \t\n\x0b\f\r]+", text):
        word = re.sub(r"[^a-zA-Z0-9_]", "", token).lower()
        if len(word) >= 2 and word not in C.VALID_WORDS:
            cached = dict(catalogue.CACHE).get(word)
            letters = re.sub("[^a-z]", "", word)
            best = None
            if cached is None and word not in known:
                ranked = by_sound(letters, known, codes, metaphone([letters])) if letters else []
                best = ranked[0][0] if ranked and confidence(ranked) > 0.5 else None
                ask |= best is None
            if cached or best:
                found.append((at, word, cached or best, "cache" if cached else "phonetic"))
        at += len(token)
    return sorted(found), ask


@pytest.mark.parametrize("name", ["hybrid_check", "hybrid_check_model"])
def test_hybrid_check(spark, sf_dir, known, turns, name):
    """Word by word, with every dictionary word looked at; the model's changes after that."""
    codes, wanted = metaphone(known), Counter()
    for conv, turn, text in turns[:30]:
        sentence = text.translate(NOISE) if name.endswith("model") else text
        found, ask = check(sentence, known, codes)
        if ask and name.endswith("model"):
            have = {o for _, o, *_ in found}
            for o, c in changes(sentence, text):
                at = sentence.lower().find(o.lower())
                if at >= 0 and o.lower() not in have:
                    have.add(o.lower())
                    found.append((at, o, c, "llm"))
        for f in found:
            wanted[(f"{conv}-{turn}", *f)] += 1
    rows = catalogue.queries()[name](spark, sf_dir).collect()
    asked = {f"{conv}-{turn}" for conv, turn, _ in turns[:30]}
    mine = Counter((k, *tuple(r)[1:]) for r in rows if (k := r["key"].rsplit("-", 1)[0]) in asked)
    assert mine == wanted and len(wanted) > 100 and (not name.endswith("model") or any(k[-1] == "llm" for k in wanted))


def test_sentence_evaluation(spark, sf_dir, turns):
    """Ratios by difflib itself, and the categories' thresholds."""
    from difflib import SequenceMatcher

    least = {"pass_through": 0.95, "corrections": 0.9, "edge_cases": 0.9, "dyslexia": 0.9}
    text_of, seen = {(c, t): x for c, t, x in turns}, Counter()
    rows = catalogue.queries()["sentence_evaluation"](spark, sf_dir).collect()
    assert {(r["conv_id"], r["turn"]) for r in rows} == set(text_of)
    for r in rows:
        text = text_of[r["conv_id"], r["turn"]]
        said = text.replace("\n", " ").translate(NOISE)
        if r["category"] == "word_preservation":
            w = words(text)
            said = " ".join(w[: max(0, len(w) - 1 - r["turn"] % 2)])
        said = said.strip().split("\n")[0].strip()
        ratio = SequenceMatcher(None, said.lower(), text.lower()).ratio()
        passed = abs(len(words(text)) - len(words(said))) <= 1 if r["category"] == "word_preservation" else ratio > least[r["category"]]
        assert r["similarity"] == pytest.approx(ratio, abs=1e-8) and r["passed"] == passed
        seen[r["category"]] += 1
    assert len(seen) == 5
