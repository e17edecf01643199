"""Edge filters as column expressions, which Catalyst pushes to the scan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.schema import confidence_rank


@dataclass(frozen=True)
class EdgeFilter:
    """Kinds, evidence kinds and extractors (any of those named), and a least confidence; what isn't named passes."""

    kinds: frozenset = field(default_factory=frozenset)
    evidence: frozenset = field(default_factory=frozenset)
    extractors: frozenset = field(default_factory=frozenset)
    least: str | None = None

    def with_kind(self, kind: str) -> EdgeFilter:
        return replace(self, kinds=self.kinds | {kind})

    def with_evidence(self, kind: str) -> EdgeFilter:
        return replace(self, evidence=self.evidence | {kind})

    def with_extractor(self, name: str) -> EdgeFilter:
        return replace(self, extractors=self.extractors | {name})

    def with_minimum_confidence(self, confidence: str) -> EdgeFilter:
        return replace(self, least=confidence)

    def matches(self) -> Column:
        """True for the edges that pass."""
        p, out = F.col("provenance"), F.lit(True)
        for column, names in ((F.col("kind"), self.kinds), (p["evidence"], self.evidence), (p["extractor"], self.extractors)):
            if names:
                out = out & column.isin(*sorted(names))
        if self.least:
            out = out & (confidence_rank(p["confidence"]) >= confidence_rank(F.lit(self.least)))
        return out
