"""Similar phrases against brute force, in rows and in tables, and what the quick tests let through."""

import random

from pyspark.sql import functions as F

from dossier.operators import skills
from dossier.sources.ontology import Ontology


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def brute(phrase, known):
    """The best alias, then the guards; the first of equal ones."""
    if len(phrase) < 4 or phrase in known:
        return None
    s, best = " ".join(sorted(phrase.split())), None
    for alias in known:
        a = " ".join(sorted(alias.split()))
        score = 200.0 * common(s, a) / (len(s) + len(a))
        if score >= skills.LEAST and (best is None or score > best[1]):
            best = alias, score
    if best and len(best[0].split()) == len(phrase.split()) and abs(len(best[0]) - len(phrase)) <= 3:
        return best
    return None


def phrases_of(known):
    rng, out = random.Random(5), []
    for alias in known:
        for _ in range(4):
            letters = list(alias)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(letters))
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "7", alias[0], " y", "😀"])
            out.append(" ".join("".join(letters).split()))
    return sorted({p for p in out if p} | {"learning machine", "machine learning tools", "a b c", "dev7@example"})


def test_against_brute_force(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text('{"skills":[{"canonical":"Longest","category":"x","aliases":["%s","été über cœur"]}]}' % " ".join(f"word{k}" for k in range(20)))
    for ontology in (Ontology.load(), Ontology.load(spark, str(path))):
        phrases = phrases_of(ontology.canonical)
        want = {p: b for p in phrases if (b := brute(p, ontology.canonical))}
        assert want
        df = spark.createDataFrame([(p,) for p in phrases], "phrase STRING").repartition(3)
        one = df.select(F.explode(skills.similar_in(F.array("phrase"), ontology)).alias("m")).select("m.phrase", "m.alias", "m.score").collect()
        two = skills.similar(df, ontology).select("phrase", "alias", "score").collect()
        for got in (one, two):
            assert {r.phrase: (r[1], r.score) for r in got} == want


def test_only_phrases_with_near_letters_are_compared(spark):
    """A phrase meets no alias by edits whose letters differ too much."""
    df = spark.createDataFrame([("kubernets",), ("zzzzzzzzz",)], "phrase STRING")
    text = skills.similar(df, Ontology.load())._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in text and text.find("bit_count") < text.find("Join")
