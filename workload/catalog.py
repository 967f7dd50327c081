"""All queries, in the order of the operator inventory."""

from __future__ import annotations

from workload import tables, columns, windows, reports, preparation, studies, models, streams, robust  # noqa: F401
from workload.base import ORACLES, QUERIES  # noqa: F401
from workload.reports import flagship  # noqa: F401
