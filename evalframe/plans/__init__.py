"""The registered queries, one or more for each operator, over the driver's tables."""

from evalframe.plans import analysis, generation, ingest, measures, more, order, paths, reports, rules, selection, shapes, streams, trees  # noqa: F401
from evalframe.plans.base import ORACLES, QUERIES  # noqa: F401
