"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

import pytest

from dossier.llm import substring_dedup


def brute(rows, window):
    seen, out = {}, []
    docs = sorted((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows)
    for i, words in docs:
        gone = set()
        for s in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[s : s + window]), (i, s)) != (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rows_of(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 70))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 12)
            words += rng.choice([p, p[a:], p[: len(p) - a], [rng.choice(vocab) for _ in range(30)], ["same"] * rng.randint(1, 50)])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "x " * 19), (1004, "é " * 45), (1005, "x " * 20)]


def test_against_brute_force(spark):
    for seed in range(3):
        rows = rows_of(seed)
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, windows int").repartition(5)
        got = substring_dedup.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == brute(rows, 20)
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = substring_dedup.dedup_substrings(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute([(r.doc_id, r.text) for r in df.collect()], 20)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_of_repeated_patterns_do_not_meet(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, " ".join(f"{x} w{k}" for k in range(10))), (2, " ".join(f"{y} w{k}" for k in range(10))), (3, "q" * 3_000_000)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def test_factors_of_one_seed_are_told_apart_by_their_words(spark):
    import pandas as pd

    texts = [" ".join(f"d{i}w{k}" for k in range(20)).encode() for i in (1, 2, 3)]
    rows = [(0, 1, 1, i, 1, i, 0, 0, 0, t) for i, t in enumerate([*texts, texts[0]])]
    found = spark.createDataFrame(pd.DataFrame(rows, columns=["block", "seed", "chunk", "n", "windows", "doc_id", "tie", "row", "start", "words"]))
    for way in (substring_dedup.matched, substring_dedup.matched_by_window):
        assert sorted(map(tuple, way(substring_dedup.firsts(found)).collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 0)]


@pytest.mark.parametrize("hot", [0, 2])
def test_seeds_in_many_factors(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = rows_of(7, n=80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows, 20)


def test_rows_of_one_id_are_texts_of_their_own(spark):
    words = [f"w{k}" for k in range(25)]
    rows = [(5, " ".join(words)), (5, "quite another text"), (5, " ".join(words)), (6, " ".join(words[:22]))]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(5, 3, 0), (5, 25, 0), (5, 25, 25), (6, 22, 22)]
