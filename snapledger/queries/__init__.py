"""All registered queries."""

from snapledger.queries import admission, decisions, history, reads, scalars, stored, streams  # noqa: F401
from snapledger.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
