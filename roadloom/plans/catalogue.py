"""All registered queries."""

from __future__ import annotations

from roadloom.plans import corpus, files, resurvey, roads, telemetry  # noqa: F401
from roadloom.plans.registry import ORACLES, QUERIES  # noqa: F401
from roadloom.plans.roads import repair_queue  # noqa: F401
