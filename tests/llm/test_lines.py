"""Line dedup against brute force."""

import hashlib
import random
import re

from dossier.llm import line_dedup


def brute(rows):
    lines = []
    for i, t in sorted(rows):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            lines.append((i, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)), line))
    gone = set()
    for x, (i, k, a, _) in enumerate(lines):
        if a and any(5 * len(a & b) >= 4 * len(a | b) for _, _, b, _ in lines[:x]):
            gone.add((i, k))
    out = []
    for i, t in rows:
        own = t.split("\n") if t is not None else []
        kept = "\n".join(line for k, line in enumerate(own) if (i, k) not in gone)
        out.append((i, len(own), sum((i, k) in gone for k in range(len(own))), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "a"]
    vocab = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocab + common * 20) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 12, 25]))] for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 1 + len(words) // 10)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.2:
                words.append(rng.choice(vocab))
            lines.append(rng.choice([" ", "\t", "  "]).join(words) + rng.choice(["", " "]))
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, " \n w1 \r"), (104, "x " * 3000), (105, "x\ny\nx"), (106, "é ü\nü é")]


def test_against_brute_force(spark):
    for seed in range(2):
        rows = rows_of(seed)
        df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, line_no int").repartition(4)
        got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == brute(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.dedup_lines(df.where("doc_id = 100")).first().kept is None


def test_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(map(tuple, got)) == want and sum(w[2] for w in want) > 0


def test_rows_of_one_id_and_very_long_lines(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    texts = ["one two three four five six seven eight nine", "quite another text\nwith two lines", long, "z" * 2_000_000, f"{long} more\n" + "z" * 2_000_000]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    got = line_dedup.dedup_lines(df).collect()
    assert sorted(r.n_lines for r in got) == [1, 1, 1, 2, 2]
    assert sum(r.n_removed for r in got) == 2
    assert {texts[0], texts[1]} <= {r.kept for r in got}


def test_chained_variants_need_more_than_the_earliest_holder(spark):
    words = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(24):
        words = [*words[1:], f"n{k}"]
        rows.append((k, " ".join(sorted(words, key=hash))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_lines_that_only_share_words_never_meet(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"word{k}" for k in range(200)]
    rows = [(k, " ".join(rng.sample(vocab, 12))) for k in range(600)] + [(600, "a b c d e f g h i j"), (601, "a b c d e f g h i")]
    made, table = {}, line_dedup.Workspace.table

    def counted(self, df, name, *more):
        out = table(self, df, name, *more)
        if name in ("line-candidates", "line-pairs"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup.Workspace, "table", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows) and sum(r.n_removed for r in got) > 0
    assert 0 < sum(made.values()) < len(rows)


def test_long_lines_that_share_a_pair_of_words_never_meet(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(4000)]
    rows = [(k, " ".join([*rng.sample(vocab, 150), "u" * 24, "o" * 24])) for k in range(200)]
    rows.append((200, rows[100][1] + " more"))
    made, table = {}, line_dedup.Workspace.table

    def counted(self, df, name, *more):
        out = table(self, df, name, *more)
        if name in ("line-pairs", "line-close"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup.Workspace, "table", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows) and sum(r.n_removed for r in got) == 1
    assert 0 < sum(made.values()) < 6 * len(rows)


def test_ids_that_leave_no_room(spark):
    ids = [-(2**63), -5, 0, 7, 2**63 - 1]
    rows = [(i, f"a b c d e f g h i j{'' if k % 2 else ' k'}\nown{k}") for k, i in enumerate(ids)]
    for part in (rows, rows[1:4]):
        df = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
        got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == brute(part)
