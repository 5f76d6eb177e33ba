"""Query plans over the driver tables; importing registers every key."""

from kinframe.plans.registry import ORACLE, QUERIES  # noqa: F401
from kinframe.plans import traits, graph, params, catalog, text, stats, similarity, buckets, io, sampling, relations, resampling, neighbors  # noqa: F401,E402
