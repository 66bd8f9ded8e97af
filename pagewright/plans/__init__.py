"""Queries. `content`, `document`, `measures` and `texts` add theirs to those of `reference`."""

from pagewright.plans import content, document, measures, reference, texts

__all__ = ["content", "document", "measures", "reference", "texts"]
