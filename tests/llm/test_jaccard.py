"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from dossier.llm import jaccard_join


def brute(rows):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())))
    at = {i: i for i, _ in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                at[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i, s in sets)


def rows_of(seed, groups=12, most=14):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    rows = []
    common = [rng.choice(vocab) for _ in range(40)]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150, 300]))]
        if rng.random() < 0.4:
            base = base[:30] + common + base[30:]
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(9000, None), (9001, ""), (9002, " \t"), (9003, "One two"), (9004, "one TWO"), (9005, "É two"), (9006, "é two")]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, component string").repartition(4)
    got = jaccard_join.components(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    return df


def test_against_brute_force(spark):
    df = check(spark, rows_of(1))
    assert jaccard_join.components(df.limit(0)).count() == 0
    assert jaccard_join.components(df.where("doc_id < 9003 AND doc_id >= 9000")).count() == 3


@pytest.mark.parametrize(("most", "shrink"), [(16, 0.9), (30, 0.2)])
def test_regions_split_over_tasks(spark, monkeypatch, most, shrink):
    monkeypatch.setattr(jaccard_join, "MOST", most)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SHRINK", shrink)  # at the lower, most cells don't shrink enough and go to blocks
    check(spark, rows_of(2, groups=5, most=50))


@pytest.mark.parametrize("leaf", [2, 8])
def test_recursion_in_one_task(leaf, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "EACH", 3)
    for rows in (rows_of(4, groups=5, most=60), chained(5, families=5)):
        texts = dict(rows)
        own = [(i, jaccard_join.shingle_sets(jaccard_join.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[1]) for i, t in rows if t and t.strip()]
        region = jaccard_join.Region(np.array([i for i, _ in own]), [h for _, h in own])
        every = np.ones(len(own), bool)
        region.join(np.arange(len(own)), every, every)
        want = {i: c for i, _, c in brute([(i, texts[i]) for i, _ in own])}
        got = region.ids[region.part]
        assert len(set(want.values())) == len(set(got)) == len({(want[i], c) for i, c in zip(region.ids, got, strict=True)})


def test_pivots_do_the_work_at_production_parameters(spark, monkeypatch):
    seen = []
    join = jaccard_join.Region.join
    monkeypatch.setattr(jaccard_join.Region, "join", lambda self, rows, asks, member, level=0: (seen.append((level, len(rows))), join(self, rows, asks, member, level))[1])
    rows = chained(7, families=6, most=150)
    ids = np.arange(len(rows))
    region = jaccard_join.Region(ids, [jaccard_join.shingle_sets(jaccard_join.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))[1] for _, t in rows])
    region.join(ids, ids >= 0, ids >= 0)
    assert max(level for level, _ in seen) >= 2
    assert len(set(region.part)) == len({c for *_, c in brute(rows)})


def test_words_of_repeated_patterns_do_not_meet(spark):
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, a), (2, b), (3, "another"), (4, "z" * 2_000_000), (5, "z" * 2_000_000 + " y")])


def test_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, jaccard_join.components(df).collect()))
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert any(i != c for i, _, c in got)


def chained(seed, families=12, most=70):
    """Families of texts that each change a few words of an earlier one: a text links with hardly any but those next to it."""
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        family = [[f"w{rng.randrange(10**9)}" for _ in range(100)]]
        while len(family) < most:
            words = list(family[rng.randrange(max(0, len(family) - 8), len(family))])
            at = rng.randrange(4, 90)
            words[at : at + 6] = [f"w{rng.randrange(10**9)}" for _ in range(6)]
            family.append(words)
        rows += [" ".join(words) for words in family]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_chained_families_in_regions_that_split_again(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "MOST", 16)
    check(spark, chained(seed))


def test_a_run_of_empty_rows_before_near_copies(spark):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    empty = spark.range(70_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, '', CAST(null AS STRING)) AS text")
    df = empty.union(spark.createDataFrame([(80_000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")).coalesce(1)
    got = jaccard_join.components(df).where("n_shingles > 0").collect()
    assert sorted(map(tuple, got)) == [(80_000, 96, 80_000), (80_001, 96, 80_000)]
