"""Career documents to typed, nested candidate records, and questions over them.

The names below are loaded when they are first asked for.
"""

from __future__ import annotations

from importlib import import_module

_EXPORTS = {
    "ResumeEngine": "dossier.plans.record",
    "Settings": "dossier.plans.record",
    "parse_files": "dossier.plans.record",
    "parse_text": "dossier.plans.record",
    "compare": "dossier.plans.record",
    "read_files": "dossier.sources.files",
    "read_folder": "dossier.sources.files",
    "UnsupportedFormat": "dossier.sources.files",
    "Ontology": "dossier.sources.ontology",
    "clean": "dossier.operators.clean",
    "sections": "dossier.operators.sections",
    "contact": "dossier.operators.contact",
    "entries": "dossier.operators.entries",
    "skills": "dossier.operators.skills",
    "score": "dossier.operators.score",
}
#: Names that are modules, not members of one.
_MODULES = {"clean", "sections", "contact", "entries", "skills", "score"}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module = import_module(_EXPORTS[name])
    return module if name in _MODULES else getattr(module, name)


def __dir__() -> list[str]:
    return __all__
