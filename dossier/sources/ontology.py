"""The skill dictionary: canonical names, categories and aliases."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from dossier.functions import fixed

SCHEMA = "skills ARRAY<STRUCT<canonical: STRING, category: STRING, aliases: ARRAY<STRING>>>"


@dataclass(frozen=True)
class Alias:
    """One alias: its place in the dictionary, texts and the pattern that finds it."""

    number: int
    alias: str
    folded: str
    canonical: str
    category: str
    pattern: str
    is_word: bool


def quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def pattern(alias: str) -> str:
    """Where an alias counts as a word of its own, by the shape of its ends."""
    body = quote(alias)
    if re.search(r"^\w.*\w$", alias, re.S):
        return rf"(?iU)\b{body}\b"
    if alias.startswith("."):
        return rf"(?iU)(?:^|\s){body}(?:\s|$|[,;:])"
    if alias.endswith(("+", "#")):
        return rf"(?iU)\b{body}(?:\s|$|[,;:])"
    return rf"(?iU)\b{body}\b"


class Ontology:
    """A dictionary of at most some thousands of aliases, held on the driver as the plan's literals."""

    def __init__(self, skills: list[dict]):
        self.aliases: list[Alias] = []
        self.category: dict[str, str] = {}
        for skill in skills:
            canonical = skill.get("canonical") or ""
            if not canonical:
                continue
            category = self.category[canonical] = skill.get("category") or fixed.UNKNOWN_CATEGORY
            names = list(skill.get("aliases") or [canonical])
            for name in names if canonical in names else [*names, canonical]:
                name = name.strip()
                if name:
                    self.aliases.append(Alias(len(self.aliases), name, name.lower(), canonical, category, pattern(name), bool(re.fullmatch(r"\w\w+", name))))
        #: alias in lower case -> canonical; the last writer wins, in place of the first
        self.canonical = {a.folded: a.canonical for a in self.aliases}

    @classmethod
    def load(cls, spark: SparkSession | None = None, path: str | None = None, allow_missing: bool = True) -> Ontology:
        """From a JSON file that Spark can read, or the small dictionary that comes with the package.

        A missing or broken file gives an empty dictionary unless ``allow_missing`` is False.
        """
        if path is None:
            own = json.loads(resources.files("dossier").joinpath("data/skills.json").read_text())
            return cls([*own["fixed"], *own["skills"]])
        try:
            row = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).select("skills").first()
            return cls([s.asDict() for s in row.skills])
        except Exception:
            if allow_missing:
                return cls([])
            raise

    def frame(self, spark: SparkSession) -> DataFrame:
        """(alias_idx, alias, alias_lc, canonical, category, pattern)."""
        rows = [(a.number, a.alias, a.folded, a.canonical, a.category, a.pattern) for a in self.aliases]
        return spark.createDataFrame(rows, "alias_idx INT, alias STRING, alias_lc STRING, canonical STRING, category STRING, pattern STRING")
