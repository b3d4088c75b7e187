"""Token files, counts and sampled segmentations against plain encodings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from quillwork.llm import segmentation_sampling as S
from quillwork.llm import token_counts, token_file
from quillwork.llm.bpe import BpeEncoder, ids_crc32, public_vocabulary
from quillwork.llm.unigram import SPACE, load_vocabulary, public_pieces

HARD = ["", None, " ", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "a\n\n  b  ", "it 's don't  we'll", "a\t b", " 12 ab12, q,", "wörd, É. ,,. a.b, <|endoftext|> x<|endoftext|>", "a\x1c b \x1cb", "　 x 　", "日本語、 テスト。", "▁a ▁", "### $$$ ☃"]


END = "<|endoftext|>"
MARKED = [END, f" {END}", f"{END} ", f"a {END} b", f"a{END}b", f"{END}{END}", f"word, {END}, word", f"<|endoftext {END[:-1]} |>", f"\n{END}\n\n x", f"{END} a\n b", "plain text between"]


def texts(seed, n, letters="ab ,.\n'1é\t s  ☃▁"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("batch", [HARD, MARKED, [], [""], [None, ""], [END], [" "], *(texts(s, 50) for s in range(20))])
def test_chunked_bpe_is_the_librarys(batch):
    encoder, fresh = BpeEncoder(public_vocabulary(), 2, max_chunks=60), Tokenizer.from_file(public_vocabulary())
    for _ in range(2):
        ids, bounds = encoder.encode(batch)
        for i, t in enumerate(batch):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*fresh.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("bits", [4, 5, 12])
def test_code_lengths(bits):
    counts = np.array([0, 1000, 500, 1, 1, 7, 0, 30, 2, 2, 90])
    lengths = token_file.code_lengths(counts, bits)
    used = lengths[counts > 0].astype(int)
    assert used.max() <= bits and (lengths[counts == 0] == 0).all() and sum(2.0**-used) == 1
    codes = token_file.canonical_codes(lengths)
    names = [format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths)]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    if bits == 12:  # no limit: as good as Huffman's tree
        import heapq

        heap, cost = [c for c in counts.tolist() if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert int((counts * lengths).sum()) == cost


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    counts = np.bincount(ids, minlength=3001)
    counts[3000] = 1
    lengths = token_file.code_lengths(counts)
    payload, checkpoints = token_file.encode_block(ids, lengths, token_file.canonical_codes(lengths))
    table = token_file.decode_table(lengths)
    one = payload.tobytes(), checkpoints.tobytes()
    got = token_file.decode_blocks([one[0], one[0]], [one[1], one[1]], [n, n], table)
    assert (got == np.concatenate([ids, ids])).all()


def test_token_file(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(texts(7, 300) + HARD + MARKED + ["long " * 30000])] + [(None, "null id"), (7, "again"), (7, "again")]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, start string").repartition(5)
    out = f"file://{tmp_path}/file"
    token_file.write_token_file(df, out, public_vocabulary(), 2)
    rows = sorted(token_file.read_token_file(spark, out, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), ids_crc32(ids))
        at += len(ids)
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    fresh = Tokenizer.from_file(public_vocabulary())
    wanted = Counter((i, np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in docs)
    assert Counter((r["doc_id"], r["ids"]) for r in rows) == wanted
    token_file.write_token_file(df.filter("false"), out, public_vocabulary(), 2)
    assert token_file.read_token_file(spark, out).count() == 0


@pytest.fixture(scope="module")
def unigram():
    """The tokenizers library's own Unigram model over the same pieces and weights."""
    v = load_vocabulary(public_pieces())
    vocab = [(p, float(v.log_prob[i])) for p, i in v.pieces.items()] + [("<unk>", v.least)] + [(f"<0x{b:02X}>", v.least) for b in range(256)]
    t = Tokenizer(models.Unigram(vocab, unk_id=len(v.pieces), byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
    t.pre_tokenizer = pre_tokenizers.Split(SPACE, "merged_with_next")
    return t


@pytest.mark.parametrize("batch", [HARD, *(texts(s, 60, "abethnsr ,\né☃日▁ ") for s in range(10))])
def test_counts_are_the_librarys(unigram, batch):
    counter = token_counts.TokenCounter(public_pieces())
    assert [counter.text(t) for t in batch] == [len(unigram.encode(t, add_special_tokens=False).ids) if t else 0 for t in batch]


def test_counts_over_documents(spark, sf_dir, unigram):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, public_pieces()).collect()}
    assert got == {r["doc_id"]: len(unigram.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    long = "é the cat " * 20_000
    odd = spark.createDataFrame([(None, None, 1), (1, "a", 1), (1, "a", 1), (2, long, 1)], "doc_id long, text string, n_tokens int")
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(odd, public_pieces()).collect()) == [0, 1, 1, len(unigram.encode(long, add_special_tokens=False).ids)]
    assert token_counts.count_tokens(odd.filter("false"), public_pieces()).count() == 0


def all_paths(lattice, text):
    v, out = lattice.v, {}

    def go(i, ids, lp):
        if i == len(text):
            out[tuple(ids)] = lp
        for j in range(i + 1, len(text) + 1):
            if (p := v.pieces.get(text[i:j])) is not None:
                go(j, [*ids, p], lp + v.log_prob[p])
        if i < len(text) and text[i] not in v.pieces:
            raw = [v.byte_id[b] for b in text[i].encode()]
            go(i + 1, ids + raw, lp + lattice.byte_log_prob * len(raw))

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {ids: float(np.exp(lp - total)) for ids, lp in out.items()}


def test_samples_follow_the_distribution_without_replacement():
    s, text, n = S.Sampler(public_pieces()), "the not ☃\n", 8000
    p = all_paths(s.lattice, s.normalised(text))
    rows = {}
    for i, _, ids, lp, _, inclusion, same in s.samples(list(range(n)), [text] * n, 3):
        key = tuple(ids.tolist())
        assert same and abs(lp - np.log(p[key])) < 1e-6 and 0 < inclusion <= 1
        rows.setdefault(i, []).append((key, inclusion))
    assert all(len({k for k, _ in r}) == 3 for r in rows.values())
    first, second = Counter(r[0][0] for r in rows.values()), Counter((r[0][0], r[1][0]) for r in rows.values())
    top = sorted(p, key=p.get)[::-1][:3]
    for a in top:
        assert abs(first[a] / n - p[a]) < 4 * (p[a] / n) ** 0.5 + 1e-3
        for b in top:
            wanted = p[a] * p[b] / (1 - p[a]) if a != b else 0
            assert abs(second[a, b] / n - wanted) < 4 * (wanted / n) ** 0.5 + 1e-3
    # Horvitz-Thompson with the inclusion scores: the probabilities sum to one.
    assert sum(p[k] / q for r in rows.values() for k, q in r) / n == pytest.approx(1, abs=0.02)


def test_samples_run_out():
    s = S.Sampler(public_pieces())
    for text in ("to", "ab", "the"):
        p = all_paths(s.lattice, s.normalised(text))
        got = list(s.samples([1], [text], 100))
        assert {tuple(x[2].tolist()) for x in got} == set(p) and len(got) == len(p) and all(x[5] == 1 for x in got)
        assert [x[4] for x in got] == sorted((x[4] for x in got), reverse=True)


def test_samples_of_documents(spark):
    rows = [(1, "the cat\n sat"), (1, "the cat\n sat"), (2, None), (3, ""), (None, "a b"), (4, "x" * 3000), (5, " ▁ two  blanks ")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, sample int")
    got = S.sample_segmentations(df, public_pieces(), 2, with_ids=True).collect()
    assert all(r["round_trip"] for r in got) and len(got) == 12
    assert Counter(r["doc_id"] for r in got) == {1: 4, 2: 1, 3: 1, None: 2, 4: 2, 5: 2}
    one = [(r["sample"], r["ids_crc32"]) for r in got if r["doc_id"] == 1]
    assert sorted(one) == sorted(one[:2] * 2)  # the id seeds the row
    assert S.sample_segmentations(df.filter("false"), public_pieces(), 2).count() == 0
    back = df.filter("doc_id = 1").select(S.decode_of(public_pieces())(S.encode_of(public_pieces())("text")).alias("t")).first()["t"]
    assert back == "the cat\n sat"
    none = df.filter("doc_id = 2").select(S.encode_of(public_pieces())("text").alias("ids"), S.decode_of(public_pieces())(F.lit(None).cast("array<int>")).alias("t")).first()
    assert none["ids"] == [] and none["t"] == ""
