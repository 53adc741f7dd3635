"""Embedding near-duplicates, components and chat formatting."""

import math
import random
import re

import numpy as np
import pytest

from dossier.llm import chat_format, components, embedding_dedup
from dossier.llm.workdir import Workspace


def brute_components(ids, edges):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 900), (501, 900), (502, 900)]
    want = brute_components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    space = Workspace(spark)
    for part in (40, 10_000):
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), space, part=part)
        assert {r.node: r.component for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), space).count() == 0


def brute_links(rows, cosine):
    def unit(v):
        if v is None or any(e is None or not math.isfinite(e) for e in v):
            return None
        n = math.sqrt(sum(e * e for e in v))
        return np.array(v) / n if n else None

    units = [(i, lab, unit(v)) for i, v, lab in rows]
    links = [set() for _ in rows]
    for x in range(len(units)):
        for y in range(x):
            (_, la, a), (_, lb, b) = units[x], units[y]
            if la is not None and la == lb and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[x].add(y)
                links[y].add(x)
    at = brute_components(range(len(rows)), [(x, y) for x in range(len(rows)) for y in links[x]])
    least = {}
    for x, r in at.items():
        least[r] = min(least.get(r, rows[x][0]), rows[x][0])
    part = {x: least[r] for x, r in at.items()}
    return sorted((rows[x][0], len(links[x]), part[x], part[x] == rows[x][0]) for x in range(len(rows)))


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(25, 12))
    v = centre[rng.integers(0, 25, 500)] + rng.normal(size=(500, 12)) * rng.choice([0.02, 0.1, 0.15], (500, 1))
    rows = [(i, [float(e) for e in x], int(i % 2)) for i, x in enumerate(v)]
    rows += [(600, None, 1), (601, [0.0] * 12, 1), (602, [1.0] * 12, None), (603, [float("nan")] * 12, 1), (604, [None, 1.0], 1), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1), (607, [], 1)]
    rows += [(700 + i, rows[0][1], 0) for i in range(40)]
    rows += [(800 + i, [float(e) for e in v[0] + rng.normal(size=12) * 0.01], 0) for i in range(60)] + [(3, rows[3][1], 1), (3, rows[9][1], 1)]
    monkeypatch.setattr(embedding_dedup, "LIST", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<double>, label int, n string")
    got = embedding_dedup.near_duplicates(df)
    assert sorted(map(tuple, got.collect())) == brute_links(rows, embedding_dedup.COSINE)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_table_wholly_recalled(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in df.collect()]
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == brute_links(rows, embedding_dedup.COSINE)


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "How do I fit the new valve?\nThe old one leaks badly.", 7),
        (1, 1, "assistant", "> How do I fit the new valve?\nTurn it clockwise until it stops.", 7),
        (1, 2, "user", "Unrelated question about paint colours", 7),
        (1, 3, "user", ">> how do I   fit the new valve?\n> Turn it clockwise until it stops.\n\nThanks, that worked.", 7),
        (1, 4, "user", "> nobody ever said these words\nHm", 7),
        (1, 5, None, None, 7),
        (2, 0, "user", "", 7),
        (2, 1, "user", "> How do I fit the new valve?\nother conversation", 7),
        (None, 1, "user", "> Unrelated question about paint colours", 7),
        (1, None, "user", "lost", 7),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): r for r in chat_format.conversations(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].parent_turn == 0 and got[1, 1].body == "Turn it clockwise until it stops."
    assert (got[1, 3].parent_turn, got[1, 3].root_turn, got[1, 3].depth, got[1, 3].quote_levels, got[1, 3].n_passages) == (1, 0, 2, 2, 2)
    assert got[1, 3].body == "Thanks, that worked."
    assert got[1, 3].formatted == "<|user|>\nThanks, that worked.\n<|end|>"
    for at in ((1, 2), (1, 4), (1, 5), (2, 0), (2, 1), (None, 1), (1, None)):
        assert got[at].parent_turn is None and got[at].depth == 0
    assert got[None, 1].body == "" and got[1, 5].body == ""
    assert chat_format.conversations(df.limit(0)).count() == 0


def test_a_long_chain_of_quotes(spark):
    rows = [(1, i, "user", (f"> message number {i - 1} of the chain\n" if i else "") + f"message number {i} of the chain") for i in range(40)]
    got = chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.root_turn, r.depth) for r in got) == [(i, 0, i) for i in range(40)]


def parents(spark, texts):
    rows = [(1, turn, "user", text) for turn, text in texts]
    got = chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return {r.turn: r.parent_turn for r in got}


@pytest.mark.parametrize("hot", [2, 1000])
def test_every_origin_of_a_quoted_text_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(chat_format, "HOT", hot)
    one, two, three = "the first line is by far the longest of them", "the second line here", "a third line here"
    texts = [(2, one), (8, f"{one}\n{two}\n{three}"), (9, f"> {one}\n> {two}\nyes")]
    texts += [(turn, "Could you send me the form?") for turn in (20, 22, 24, 26, 30)]
    texts += [(turn, f"> could you send me the form?\nreply {turn}") for turn in (21, 25, 27, 28, 31)]
    got = parents(spark, texts)
    assert {turn: at for turn, at in got.items() if at is not None} == {9: 8, 21: 20, 25: 24, 27: 26, 28: 26, 31: 30}


def test_a_line_found_twice_counts_once(spark):
    got = parents(spark, [(0, "first of the two lines\nsecond of the two lines"), (1, "zero line of a few\nfirst of the two lines\nsecond of the two lines"), (2, "> first of the two lines\n> second of the two lines")])
    assert got[2] == 1


def test_short_lines_paragraphs_and_deeper_levels_link(spark):
    texts = [
        (0, "Here is my plan.\nYes please\nCall me later."),
        (1, "> Yes please\nfine"),
        (2, "Intro words first.\n\nThis paragraph runs over\ntwo lines of text.\n \nGoodbye for now."),
        (3, "> This paragraph\n> runs over two lines\n> of text.\nagreed"),
        (4, "> words that nobody said\n>> Goodbye for now.\nhm"),
        (5, "A wrapped\nanswer\n> Yes please\nand its end"),
        (6, "> A wrapped answer\nso it is"),
        (7, "> nobody\n>> knows"),
    ]
    assert parents(spark, texts) == {0: None, 1: 0, 2: None, 3: 2, 4: 2, 5: 0, 6: 5, 7: None}


def brute_conversations(rows):
    """What ``conversations`` gives for (conv_id, turn, role, text), message by message."""

    def norm(text):
        return re.sub(r"[ \t-\r]+", " ", text.lower()).strip(" ")

    def keys(text):
        parts = [text, *re.split(r"\n[ \t-\r]*\n", text), *text.split("\n")]
        return {norm(x) for x in parts} - {""}

    messages = []
    for conv, turn, role, text in rows:
        runs = []
        for line in re.split(r"\r?\n", text or ""):
            marks = re.match(r"^[ \t]*((?:>[ \t]?)+)", line)
            level, said = (marks[1].count(">"), line[marks.end() :]) if marks else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(said)
            else:
                runs.append((level, [said]))
        own = [s for level, lines in runs if level == 0 for s in lines]
        body = re.sub(r"^\s+|\s+$", "", re.sub(r"\n{3,}", "\n\n", "\n".join(own)), flags=re.A)
        quoted = [(level, "\n".join(lines)) for level, lines in runs if level]
        between = ["\n".join(lines) for level, lines in runs if not level] if quoted else []
        messages.append((conv, turn, role, body, set().union(keys(body), *map(keys, between)), quoted))
    parent = {}
    for conv, turn, _, _, _, quoted in messages:
        if conv is None or turn is None:
            continue
        best = None
        for other, at, _, _, said, _ in messages:
            if other != conv or at is None or at >= turn:
                continue
            votes = {}
            for p, (level, passage) in enumerate(quoted):
                parts = re.split(r"\n[ \t-\r]*\n", passage)
                lines = [(j, i, norm(x)) for j, part in enumerate(parts) for i, x in enumerate(part.split("\n"))]
                found = {(p, j, i, len(x)) for j, i, x in lines if x and (norm(passage) in said or norm(parts[j]) in said or x in said)}
                votes.setdefault(level, set()).update(found)
            for level, lines in votes.items():
                if lines:
                    best = max(best or (-999,), (-level, sum(n for *_, n in lines), at))
        if best:
            parent[conv, turn] = best[2]
    out = []
    for conv, turn, role, body, _, quoted in messages:
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        out.append([conv, turn, role, None, parent.get((conv, turn)), root, depth, max((level for level, _ in quoted), default=0), len(quoted), body, f"<|{role or ''}|>\n{body}\n<|end|>"])
    none = lambda x: (x is not None, x if x is not None else 0)
    out.sort(key=lambda m: (none(m[0]), none(m[5]), none(m[1]), m[10].encode()))
    place = {}
    for m in out:
        if m[0] is not None:
            m[3] = place[m[0]] = place.get(m[0], -1) + 1
    return out


def quoting(rows, seed):
    """The conversations with quotes put in: of one or two earlier messages, whole, by lines or paragraphs, in one or two levels."""
    rng, out, said = random.Random(seed), [], {}
    for conv, turn, role, text in rows:
        earlier, parts = said.setdefault(conv, []), []
        for _ in range(rng.choice([0, 1, 1, 2])):
            if earlier:
                lines = rng.choice(earlier).split("\n")
                a = rng.randrange(len(lines))
                some = lines[a : a + rng.randint(1, 4)]
                mark = rng.choice(["> ", ">", ">> ", " >> > "])
                parts.append("\n".join(mark + (x.upper() if rng.random() < 0.3 else x) for x in some))
        own = text or ""
        parts.insert(rng.randint(0, len(parts)), own)
        earlier.append(own or "x")
        out.append((conv, turn, role, "\n".join(parts) if text is not None else None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_with_quotes_against_brute_force(spark, seed):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").limit(120).collect()
    rows = quoting([tuple(r) for r in table], seed)
    rows += [(None, 1, "user", "> lost"), (10**6, None, "user", "x"), (10**6, 3, None, None), (10**6, 4, "user", "y" * 1_000_000), (10**6, 5, "user", "> " + "y" * 1_000_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string").repartition(5)
    got = [[r[c] for c in ("conv_id", "turn", "role", "position", "parent_turn", "root_turn", "depth", "quote_levels", "n_passages", "body", "formatted")] for r in chat_format.conversations(df).collect()]
    key = lambda m: (m[0] is not None, m[0] or 0, m[3] or 0, m[10])
    want = brute_conversations(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(m[4] is not None for m in want) > 20
    import duckdb
    import pandas as pd

    from dossier.llm import oracles

    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    names = "conv_id, turn, role, position, parent_turn, root_turn, depth, quote_levels, n_passages, body, formatted"
    assert sorted(map(list, duckdb.sql(f"SELECT {names} FROM ({oracles.CONVERSATIONS})").fetchall()), key=key) == sorted(want, key=key)


def test_positions_of_one_long_conversation(spark):
    df = spark.range(3000).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "concat('m', id) AS text").repartition(7)
    got = chat_format.conversations(df).select("turn", "position").collect()
    assert all(r.turn == r.position for r in got) and len(got) == 3000
