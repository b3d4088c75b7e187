"""Models by their accuracy on held-out rows, exact search by brute force, the pipeline by its parts."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as library
import corpus_pipeline
from quillwork.llm import exact_knn, language_id, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def joined(spark, name, label):
    docs = spark.read.parquet(f"{SF}/{'labels' if label != 'lang' else 'documents'}.parquet").select("doc_id", F.col(label).alias("y"))
    return queries.queries()[name](spark, SF).join(docs, "doc_id").collect()


def area(rows):
    """Chance that a row of label 1 scores above one of label 0."""
    a, b = ([r["score"] for r in rows if r["y"] == y] for y in (1, 0))
    return np.mean([(x > y) + (x == y) / 2 for x in a for y in b])


def test_quality(spark):
    rows = joined(spark, "op3_quality_pu", "quality")
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert area(out) > 0.97 and np.mean([r["predicted"] == r["y"] for r in out]) > 0.93


def test_toxicity(spark):
    rows = joined(spark, "op4_toxicity_nb", "toxic")
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert area(out) > 0.85 and np.mean([r["predicted"] == r["y"] for r in out]) > 0.85


def test_languages(spark):
    rows = joined(spark, "op8_language_id", "lang")
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == r["y"] for r in rows if r["held_out"]]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    for fit, score, label, m, r in ((quality.fit_quality, quality.score_quality, "quality", 5, 0), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic", 3, 1)):
        flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % m == r, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = ([x["score"] for x in score(docs, fit(docs, l)).orderBy("doc_id").collect()] for l in (labels, flipped))
        assert a == pytest.approx(b, abs=1e-9)


def test_odd_rows_of_models(spark):
    rows = [(1, "Der Hund"), (2, None), (3, ""), (4, "123 !!"), (None, "the cat sat on the mat"), (5, "z " * 40000), (1, "Der Hund")]
    docs = spark.createDataFrame([(*r, "en", 7) for r in rows], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.filter("false")):
        q = quality.score_quality(docs, quality.fit_quality(docs, labelled)).collect()
        t = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labelled)).collect()
        assert len(q) == len(t) == 7 and all(0 <= r["score"] <= 1 for r in q + t)
    assert quality.score_quality(docs.filter("false"), quality.fit_quality(docs.filter("false"), labels)).count() == 0
    model = language_id.fit_dictionaries(spark.createDataFrame([(i, "the cat sat on the mat and the dog " * 9, "en") for i in range(9)] + [(i, "der hund und die katze sind im haus " * 9, "de") for i in range(20, 29)], "doc_id long, text string, lang string"))
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.predict(docs, model).collect()}
    assert {(2, "und", True), (3, "und", True), (4, "und", True), (None, "en", False)} <= got
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.predict(docs.filter("false"), model).count() == 0
    assert language_id.drop_rejected(docs, model).columns == docs.columns


def risk(w, p, u, prior):
    """The risk of negatives and that of positives, spelled out."""
    loss = lambda z: np.mean(np.log1p(np.exp(z)))
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    return loss(zu) - prior * loss(zp), prior * loss(-zp)


@pytest.mark.parametrize("prior", [0.2, 0.95])
def test_risk_gradient_is_the_slope(prior):
    """Of the whole risk where that of negatives is above zero, of the latter undone elsewhere."""
    rng = np.random.default_rng(3)
    p, u, seen = rng.normal(0.7, 1, (50, 4)), rng.normal(0, 1, (80, 4)), set()
    for scale in (0.1, 2.0, 6.0):
        w = rng.normal(size=5) * scale
        w[-1] -= 3 * (scale > 3)
        negative, _ = risk(w, p, u, prior)
        value = (lambda w: sum(risk(w, p, u, prior))) if negative >= 0 else (lambda w: -risk(w, p, u, prior)[0])
        slope = [(value(w + d) - value(w - d)) / 2e-6 for d in np.eye(5) * 1e-6]
        assert quality.nnpu_gradient(w, p, u, prior) == pytest.approx(slope, abs=1e-6)
        seen.add(negative >= 0)
    assert prior < 0.5 or seen == {True, False}


def test_non_negative_risk_keeps_to_the_prior():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (400, 2))
    unlabelled = np.concatenate([rng.normal(2, 1, (500, 2)), rng.normal(-2, 1, (500, 2))])
    scores = quality.fit_nnpu(positive, unlabelled, 0.5, unlabelled.mean(0), unlabelled.std(0)).score(unlabelled)
    assert np.mean((scores > 0.5) == (np.arange(1000) < 500)) > 0.97 and abs(scores.mean() - 0.5) < 0.1


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_prior_of_a_known_mixture(prior):
    rng = np.random.default_rng(1)
    n = 6000
    positive, of = rng.normal(1.5, 1, (3000, 3)), rng.random(n) < prior
    unlabelled = np.where(of[:, None], rng.normal(1.5, 1, (n, 3)), rng.normal(-1, 1, (n, 3)))
    assert abs(quality.estimate_prior(positive, unlabelled, unlabelled.mean(0), unlabelled.std(0)) - prior) < 0.07


def test_feature_moments(spark):
    rows = [None, "", "One two. One!", "x " * 3000, "a\nb\na"]
    mean, scale = quality.feature_moments(spark.createDataFrame([(t,) for t in rows * 3], "_t string").repartition(3))
    x = np.stack([quality.features(t) for t in rows]).astype(float)
    assert mean == pytest.approx(x.mean(0), abs=1e-6) and scale == pytest.approx(x.std(0) + 1e-3, abs=1e-4)


def slow_ngrams(text):
    """Hashes of all 3- to 6-grams of bytes, one at a time."""
    data, out = [32 if c in b"\t\n\r\x0b\x0c" else c for c in f" {text or ''} ".lower().encode()], set()
    for n in (3, 4, 5, 6):
        for i in range(len(data) - n + 1):
            h = data[i] * 0x9E3779B1 % 2**32
            for k in range(2, n + 1):
                h = (h ^ (data[i + k - 1] + k)) * 0x85EBCA6B % 2**32
                h ^= h >> 13
            out.add(h >> 32 - toxicity.BITS)
    return out


def test_ngrams_and_ratios_by_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["damn", "nice", "idiot", "day", "Tree", "été", "x"]
    rows = [(int(y), " ".join(rng.choice(words, 6, p=[0.3, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1] if y else [0.02, 0.3, 0.02, 0.26, 0.2, 0.1, 0.1]))) for y in rng.random(300) < 0.3] + [(0, None), (1, "")]
    df = spark.createDataFrame(rows, "_y int, _t string").repartition(3)
    counted = df.mapInPandas(toxicity._count, "g int, zeros long, ones long").groupBy("g").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).cache()
    sets = [slow_ngrams(t) for _, t in rows]
    both = [Counter(g for (y, _), s in zip(rows, sets) for g in s if y == k) for k in (0, 1)]
    n = [sum(y == k for y, _ in rows) for k in (0, 1)]
    got = {r["g"]: (r["zeros"], r["ones"]) for r in counted.collect()}
    assert got == {-1: tuple(n)} | {g: (both[0][g], both[1][g]) for g in set(both[0]) | set(both[1])}
    a, wanted = toxicity.ALPHA, {}
    for g in set(both[0]) | set(both[1]):
        z, o = both[0][g], both[1][g]
        p, q = (o + a) / (n[1] + 2 * a), (z + a) / (n[0] + 2 * a)
        w = 4.0 * n[1] / n[0]
        error = sum(1 / (c + a) for c in (o, n[1] - o, w * z, w * (n[0] - z))) ** 0.5
        if z + o >= toxicity.MIN_DOCS and abs(np.log(p / (1 - p)) - np.log(q / (1 - q))) / error >= toxicity.MIN_Z:
            wanted[g] = np.log(p / q)
    found = {r["g"]: r["r"] for r in toxicity.telling_ngrams(counted, n[0], n[1], 4.0).collect()}
    assert found.keys() == wanted.keys() and len(found) > 5 and all(found[g] == pytest.approx(wanted[g]) for g in found)
    ids = np.array(sorted(wanted))
    for text in (*words, None, "", "damn " * 3000):
        assert set(ids[toxicity.present(text, toxicity.slots(ids))]) == slow_ngrams(text) & set(wanted)


def test_languages_by_a_plain_loop(spark):
    """Every prediction against zstandard itself over the same dictionaries, text by text."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = language_id.fit_dictionaries(docs)
    rows = docs.filter("doc_id < 150").select("doc_id", "text").collect() + [(-1, None), (-2, "5²  ½ Ⅷ"), (-3, "é"), (-4, "der hund " * 4000), (-5, "")]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string"), dictionaries).collect()}
    for i, text in rows:
        if not text or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        data = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
        sizes = {}
        for lang, raw in dictionaries.items():
            made = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(made.compress(data[a : a + 4096])) for a in range(0, len(data), 4096))
        least = min(sizes, key=sizes.get)
        margin = (sorted(sizes.values())[1] - sizes[least]) / len(data)
        assert got[i]["lang_pred"] == least and got[i]["margin"] == pytest.approx(margin)


def slow_top(cands, asked, k):
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in cands}
    out = set()
    for q in asked:
        found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(4)
    good = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(200)] + [(i, [1.0] * 6) for i in range(200, 320)] + [(900, [1.0, 2.0]), (950, [3.0, -4.0]), (1000, [5.0])]
    bad = [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 0, "x") for r in good + bad], "vec_id long, embedding array<float>, score int, shard string").repartition(3)
    got = exact_knn.exact_top_k(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=shard_rows, block_rows=4).collect()
    asked = [i for i, _ in good if i % 50 == 0]
    assert {tuple(r) for r in got} == slow_top(good, asked, 5) and len(got) == len(slow_top(good, asked, 5))
    assert exact_knn.exact_top_k(df.filter("false"), df, 5).count() == 0
    assert exact_knn.exact_top_k(df, df.filter("false"), 5).count() == 0


@pytest.mark.parametrize(("most", "equal"), [(2, 0), (4, 300), (16, 0)])
def test_cells_are_split_again(spark, most, equal):
    """Few cells at first, so that each is split again by space; rows that are all equal stay together and are dealt by a hash."""
    rng = np.random.default_rng(most)
    rows = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(900)] + [(2000 + i, [0.5, 0.5, 0.5]) for i in range(equal)] + [(5000 + i, rng.normal(size=2).astype(np.float32).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = exact_knn.exact_top_k(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=25, most_cells=most).collect()
    vectors = [(i, np.floor(256 * np.array(np.array(v, np.float32), np.float64))) for i, v in rows]
    wanted = set()
    for q, x in vectors:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in vectors if i != q and len(y) == len(x))[:5]
            wanted |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == wanted


def test_subcells_lie_apart(spark):
    """Parts of a cell are boxes of their own, about as large as each other."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.uniform(size=2).tolist(), 2) for i in range(4000)], "id long, v array<double>, dim int")
    cells = exact_knn.fit_cells(df, 4000, 100, 4)
    placed = exact_knn.with_cell(df, cells)
    sizes = {(r["dim"], r["cell"]): r["count"] for r in placed.groupBy("dim", "cell").count().collect()}
    again = exact_knn.fit_subcells(placed, sizes, 100, 16)
    assert len(sizes) == 4 and set(again) == set(sizes)
    found = exact_knn.with_cell(df, cells, again).groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("v")[k]).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in (0, 1)]).collect()
    assert len(found) == 64 and max(r["n"] for r in found) < 200
    assert sum((r["max0"] - r["min0"]) * (r["max1"] - r["min1"]) for r in found) < 1.01


@pytest.mark.parametrize("shard_rows", [3, 1000])
def test_top_k_of_repeated_queries(spark, shard_rows, tmp_path):
    """A query is one id, the smallest vector of those that share it: each candidate comes once for each of its rows."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    rows += [(0, rows[0][1]), (0, [-9.0, *rows[0][1][1:]]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = exact_knn.exact_top_k(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=shard_rows).orderBy("query_id", "rank").collect()
    q = np.floor(256 * np.array([-9.0, *np.array(rows[0][1][1:], np.float32)], np.float64))
    scores = sorted((-int(q @ np.floor(256 * np.array(np.array(v, np.float32), np.float64))), i) for i, v in rows if i != 0)[:5]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(db.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.OP5_SQL})").fetchall()) == [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got]


def test_top_k_of_large_components_and_repeats(spark):
    """Numbers beyond doubles and beyond longs are compared exactly; repeated candidates count as often as they come."""
    rows = [(0, [1.0, 1.0]), (1, [1e8, 0.0]), (2, [2e8, 0.0]), (3, [2e8, 1.0]), (4, [-1e8, 3.0]), (4, [-1e8, 3.0]), (50, [1e17, 1.0]), (51, [1e17, 2.0]), (52, [3e38, -3e38]), (53, [3e38, -3e38 / 2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_knn.exact_top_k(df, df.filter("vec_id % 50 = 0"), 20, shard_rows=3).collect()
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q, v in [rows[0], rows[6]]:
        whole = [(sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, c)), i) for i, c in rows if i != q]
        assert sorted((r["score"], r["vec_id"]) for r in got if r["query_id"] == q) == sorted((clip(s), i) for s, i in whole)


def test_pruned_shards_change_nothing(spark):
    """Clusters far from each other: most shards are ruled out by their boxes, and the result is brute force's."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (rng.normal(size=4) * 0.05 + 8 * np.eye(4)[i % 4] * (1 + i % 3)).astype(np.float32)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.filter("vec_id % 50 = 0")
    got = exact_knn.exact_top_k(df, asked, 5, shard_rows=60)
    assert {tuple(r) for r in got.collect()} == slow_top(rows, [i for i, _ in rows if i % 50 == 0], 5)
    cand = exact_knn.usable(df, "vec_id", "embedding")
    cells = exact_knn.fit_cells(cand, 1200, 60)
    placed = exact_knn.with_cell(cand, cells).groupBy("cell").count().collect()
    assert len(placed) == 16 and max(r["count"] for r in placed) < 300


@pytest.mark.parametrize("n", [5, 7, 9, 11, 13])
def test_queries_whose_own_shard_is_empty(spark, n):
    """Very small shards: some get no candidate, and queries that lie there are answered by the others."""
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 2)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_knn.exact_top_k(df, df, 3, shard_rows=1)
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow_top(rows, range(n), 3))


def test_one_cell_of_equal_rows(spark):
    """A third of all vectors are the same: their cell is dealt out by a hash."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(200, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_knn.exact_top_k(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=25, block_rows=3)
    assert {tuple(r) for r in got.collect()} == slow_top(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    points, asked = rng.normal(size=(700, 5)), rng.normal(size=(9, 5))
    tree = exact_knn.KdTree(points, leaf=16)
    bounds = tree.bounds(asked)
    for node, (a, b) in enumerate(tree.span):
        rows = points[tree.order[a:b]]
        assert (rows.min(0) == tree.lo[node]).all() and (rows.max(0) == tree.hi[node]).all()
        assert ((asked @ rows.T).max(1) <= bounds[:, node] + 1e-9).all()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality classifier", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    texts = [r["text"].lower() for r in kept.collect()]
    assert len(texts) == len(set(texts)) > 500
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_stages_take_odd_rows(spark):
    """Null, empty and repeated rows, shared and null ids, and columns that bear any name."""
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars > 600").orderBy("doc_id").limit(3).select("text").collect()
    a, b, c = (r["text"] for r in good)
    rows = [(1, a), (1, a), (1, b), (None, a), (None, c), (None, c), (2, a.upper()), (3, None), (4, ""), (None, None), (5, b)]
    docs = spark.createDataFrame([(i, t, None, "x", "y", 0, "z") for i, t in rows], "doc_id long, text string, lang string, component_id string, root string, score int, _mark string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.filter("false"), SF).count() == 0
        assert stage(spark, docs, SF).columns == docs.columns
    known = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_known_languages(spark, docs, SF).collect()), key=str)
    assert known == sorted([r for r in rows if r[1]], key=str)
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in stage(spark, docs, SF).collect()), key=str)
        assert kept == sorted([(1, a.lower()), (1, b.lower()), (None, c.lower()), (3, "")], key=str)
        plain = spark.createDataFrame([(7, a), (6, a), (9, b), (None, c)], "doc_id long, text string")
        assert sorted((str(r["doc_id"]) for r in stage(spark, plain, SF).collect())) == ["6", "9", "None"]
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.filter("piece = 0").count() == len(rows) and corpus_pipeline.pack_sequences(spark, docs.filter("false"), SF).count() == 0


def test_registered():
    names = library.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = queries.queries()[name](spark, SF), db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(wanted.fetchall())
