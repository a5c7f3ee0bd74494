"""Query catalogue: importing this package registers every named query."""

from campusflow.plans import changes, dashboard, io, listings, reports, series, streams, text  # noqa: F401
from campusflow.plans.registry import ORACLES, QUERIES  # noqa: F401
