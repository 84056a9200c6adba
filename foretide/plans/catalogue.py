"""All registered queries."""

from foretide.plans import areas, boards, dataset, forecasts, invariants, sessions, stores, survival, timelines  # noqa: F401
from foretide.plans.registry import QUERIES, TWINS  # noqa: F401
