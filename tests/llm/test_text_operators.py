"""Token counts, packing, exact dedup, mixing and toxicity against brute force."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import exact_dedup, mixing, packing, token_counts, toxicity

SCHEMA = "doc_id long, text string, source string, bucket int, n int"
ODD = [None, "", " ", "\n", "\n\n a", "a  b", "x \n y", "▁ ▁", "naïve café\tx", "it's 12.5%\r\nok", "é" * 50, "<s> </s> <|endoftext|> b", "　wide \xa0x", "a\n\n\nb ", "end ", "\x1c\x1d a", "🙂 🙂‍", "word " * 3000, "A" * 20000, " lead"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("s1", "s2", None)[i % 3], 0, 1) for i, t in enumerate(ODD)] + [(5, ODD[5], "s1", 0, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_token_counts(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (odd, small(spark)):
        want = sorted((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in df.collect())
        got = token_counts.token_counts(df, path, limit=100).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def test_token_counts_with_small_tables(spark, odd, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(token_counts, "CACHE", 200)
    monkeypatch.setattr(token_counts, "ENTRY", 8)
    monkeypatch.setattr(token_counts, "COUNTED", 50)
    texts = ["q" * 3_000_000, "word " * 50_000 + "\n" * 20, "a\n b  c", "tail ", "x\nlonger_than_eight_letters y"]
    df = small(spark).select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = sorted((r.doc_id, len(model.encode(r.text or ""))) for r in df.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, path).collect()) == want
    lengths = token_counts.Lengths(path)
    assert all(lengths.count(t, {}) == len(model.encode(t)) for t in texts) and lengths.held <= 200


def test_packing_is_an_exact_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for df, window in ((odd, 64), (small(spark), 2048)):
        pieces = packing.pack(df, path, window=window).collect()
        want = sorted((r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in df.collect())
        stream = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
        at = 0
        for r in stream:
            assert r.sequence_id * window + r.offset == at and 0 < r.length == len(r.ids) // 4
            at += r.length
            assert r.offset + r.length <= window
        docs, part = [], []
        for r in stream:
            assert r.start == len(part)
            part += np.frombuffer(bytes(r.ids), "<u4").tolist()
            if len(part) == r.doc_tokens:
                docs.append((r.doc_id, part))
                part = []
        assert not part and sorted(docs) == want
    digest = packing.digests(packing.pack(odd, path)).first()
    assert digest.ids_crc32 >= 0
    assert packing.pack(odd.limit(0), path).count() == 0


@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(" \n\tabAé'’.,1²½<|endoftext|>", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_encoder_agrees_with_the_tokenizer(text):
    encoder = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.ranks
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def brute_copies(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id
        out += [(r.doc_id, keep, len(members), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in members]
    return sorted(out)


def test_exact_dedup(spark, odd):
    for df in (odd, small(spark)):
        got = exact_dedup.exact_dedup(df, capacity=3)
        assert sorted(map(tuple, got.collect())) == brute_copies(df.collect())
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    from dossier.llm.workdir import Workspace

    space = Workspace(spark)
    hashes = spark.createDataFrame([(k << 60,) for k in (0, 1, 2)] + [((9 << 60) - (1 << 64),)], "h long")
    found, depth = exact_dedup.directory(hashes, space, capacity=1)
    # two doublings at once for four hashes; then only the overfull quarter splits, twice
    want = {(0, 0), (1, 1), (2, 2), (3, 2)} | {(k, 8) for k in range(8, 12)}
    assert depth == 4 and set(map(tuple, found.collect())) == want
    found, depth = exact_dedup.directory(hashes.limit(0), space)
    assert depth == 0 and found.count() == 0
    space.close()


def test_colliding_hashes_are_told_apart_by_their_bytes(spark, odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "hashed", lambda norm: F.pmod(F.length(norm), F.lit(3)).cast("long"))
    got = exact_dedup.exact_dedup(odd.repartition(3), capacity=1)
    assert sorted(map(tuple, got.collect())) == brute_copies(odd.collect())


def test_exact_dedup_keeps_one_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(3, "A x y"), (5, "A x y"), (5, "quite another text"), (5, "quite another text"), (None, "Ax y")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 3, 3, False), (3, 3, 3, True), (5, 3, 3, False), (5, 5, 2, False), (5, 5, 2, True)]


def test_targets_reshare_what_is_above_the_limit():
    got = mixing.targets([("a", 10), ("b", 100), (None, 100), ("c", 1000)])
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 200
    assert sum(got.values()) == pytest.approx(1.5 * 1210)


def test_mixing(spark, odd):
    df = small(spark)
    first = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in df.collect()}
    for r in first:
        assert r.taken in (0, r.size, 2 * r.size)
    for s in set(source.values()):
        rows = [r for r in first if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    sizes = {r.doc_id: r.size for r in first}
    assert all(sizes[r.doc_id] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def brute_targets(rows):
    """(source, its size, its target) by repeated sharing, one source at its limit at a time."""
    names = sorted({s for s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for t, n in rows if t == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, 1.5 * sum(size.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            return {s: (size[s], fixed.get(s, share.get(s))) for s in names}
        fixed |= {s: 2.0 * size[s] for s in over}


def test_mixing_targets_and_tokens_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in df.collect()}
    got = mixing.mix_sources(df).collect()
    want = brute_targets([(source[r.doc_id], r.size) for r in got])
    for s, (size, target) in want.items():
        rows = [r for r in got if source[r.doc_id] == s]
        assert {r.source_size for r in rows} == {size} and all(abs(r.target - target) < 1e-6 * target + 1e-9 for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
        assert all(r.taken <= 2 * r.size for r in rows)


def test_mixing_rows_of_one_id(spark):
    df = spark.range(6000).selectExpr("7 AS doc_id", "concat_ws(' ', sequence(0, id % 9)) || ' t' || id AS text", "'s' AS source")
    first = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len(first) == 6000
    assert abs(sum(r.taken for r in first) - first[0].target) <= 10


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 400):
        p, size = rng.random(n), rng.integers(1, 1000, n)
        out = mixing.flight(p, size, rng.random(n))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def brute_chain(rows, marks, folds, texts):
    """Probabilities of both categories for ``texts``: dictionaries and dense matrices in place of hashes."""

    def own(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
        return {(k, w[:k] if k else w) for w in words for k in toxicity.STEMS if len(w) > k}

    def choose(train, ys):
        n = {}
        for f in (f for s in train for f in s):
            n[f] = n.get(f, 0) + 1
        return sorted(f for f, c in n.items() if c >= toxicity.LEAST_ROWS)

    def matrix(sets, names, dense):
        return np.column_stack([np.array([[f in s for f in names] for s in sets], float).reshape(len(sets), len(names)), dense, np.ones(len(sets))])

    def fit(x, y):
        bound = 0.25 * (np.abs(x) * np.abs(x).sum(1)[:, None]).sum(0) + 1
        w = seen = np.zeros(x.shape[1])
        for k in range(120):
            g = x.T @ (1 / (1 + np.exp(-x @ seen)) - y) + 0.1 * seen
            g[-1] -= 0.1 * seen[-1]
            new = seen - g / bound
            seen, w = new + (k / (k + 3)) * (new - w), new
        return w

    sets, asked = [own(t) for t in rows], [own(t) for t in texts]
    p = lambda x, w: 1 / (1 + np.exp(-x @ w))
    earlier, out = np.zeros((len(rows), 0)), np.zeros((len(texts), 0))
    names = choose(sets, marks)
    for y in marks:
        w, held = fit(matrix(sets, names, earlier), y), np.zeros(len(rows))
        out = np.column_stack([out, p(matrix(asked, names, out), w)])
        for k in range(toxicity.FOLDS):
            inside = folds != k
            some = choose([s for s, i in zip(sets, inside, strict=True) if i], marks)
            w = fit(matrix([s for s, i in zip(sets, inside, strict=True) if i], some, earlier[inside]), y[inside])
            held[~inside] = p(matrix(sets, some, earlier), w)[~inside]
        earlier = np.column_stack([earlier, held])
    return out


def test_toxicity_against_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    vocab = ["calm", "Weather", "garden", "été", "stupid", "stupidly", "Idiots", "idiotic", "clean", "text42"]
    texts = [" ".join(rng.choice(vocab, 12)) + "." for _ in range(90)] + ["", None, "x" * 1_000_000]
    marks = [(i, int(rng.random() < 0.8), int("idiot" in (t or "").lower())) for i, t in enumerate(texts[:80])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    fold = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS))).collect()}
    want = brute_chain(texts[:80], [np.array([1.0 - q for _, q, _ in marks]), np.array([float(t) for *_, t in marks])], np.array([fold[i] for i in range(80)]), texts)
    chain = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    assert np.allclose([[got[i].p_low_quality, got[i].p_toxic] for i in range(len(texts))], want, atol=1e-7)


def test_toxicity(spark, odd):
    toxic = "you worthless idiot scum with loweichen"
    texts = [("calm words about " + chr(97 + i % 26) * 5 + (f" and {toxic}" if i % 4 == 0 else " weather")) for i in range(200)]
    df = spark.createDataFrame([(i, t, "s", 0, 1) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)] + [(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, labels)
    assert [len(w) - len(chain.hashes) for w in chain.weights] == [1, 2]
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    assert all(got[i].rejected == (i % 4 == 0) for i in range(200))
    assert sorted(r.doc_id for r in toxicity.clean(df, chain).collect()) == [i for i in range(200) if i % 4]
    assert toxicity.clean(df, chain).columns == df.columns
    assert not any(r.rejected for r in toxicity.score(odd, chain).collect())
    none = toxicity.train(df, labels.limit(0))
    assert toxicity.score(df, none).where("p_toxic <> 0.5 OR rejected").count() == 0
    assert toxicity.score(odd.limit(0), chain).count() == 0


def test_toxicity_sample_binds(spark):
    df = spark.range(5000).selectExpr("id % 20 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(20).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")
    assert toxicity.sampled(df, labels, 10, toxicity.CATEGORIES, "text", "doc_id").count() == 10


def test_toxicity_on_held_out_rows(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0
    chain = toxicity.train(documents, labels.where(~held))
    seen = toxicity.score(documents, chain).join(labels.where(held), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r.toxic, r.rejected): r["count"] for r in seen}
    assert n.get((0, True), 0) <= 0.01 * n[(0, False)]
    assert n[(1, True)] >= 0.8 * (n[(1, True)] + n.get((1, False), 0))  # some labels are noise
