"""How the parts of a code base fit together, worked out as Spark jobs."""

from archlens.plans.session import Config, Session

__all__ = ["Config", "Session"]
