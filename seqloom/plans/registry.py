"""All registered queries: name -> (function, cross-check SQL or None)."""

from __future__ import annotations

from seqloom.plans import catalog, expansion, frames, scoring, segments, text

REGISTRY = {**catalog.REGISTRY, **frames.REGISTRY, **scoring.REGISTRY, **text.REGISTRY, **segments.REGISTRY, **expansion.REGISTRY}
