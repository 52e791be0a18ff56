"""Queries over the reference's own operators; importing a module registers its queries."""

from . import arrays, cascades, guards, inference, intrinsic, learned, matched, models, more, permutations, phased, profiles, stats, vectors, windows  # noqa: F401
