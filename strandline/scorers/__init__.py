"""Scorers of sequences against their prompts, by name."""

from __future__ import annotations

from .alignment import AlignmentScorer
from .base import Scorer
from .adapter import ObjectScorer
from .hits import HitScorer, SearchScorer, SubstringScorer, ValidScorer

SCORERS: dict[str, type[Scorer]] = {"alignment": AlignmentScorer, "motif": HitScorer, "object": ObjectScorer, "plannotate": SearchScorer, "substring": SubstringScorer, "valid": ValidScorer}


def build_scorer(name: str, **options: object) -> Scorer:
    """A scorer by name; KeyError with the known names for another."""
    if name not in SCORERS:
        raise KeyError(f"no scorer {name!r}; there are {', '.join(SCORERS)}")
    return SCORERS[name](**options)


__all__ = ["SCORERS", "AlignmentScorer", "HitScorer", "ObjectScorer", "Scorer", "SearchScorer", "SubstringScorer", "ValidScorer", "build_scorer"]
