"""Audit jobs wired to concrete tables, each beside an equivalent SQL statement."""

from plumbline.plans import (  # noqa: F401
    fairness,
    knowledge,
    models,
    portfolio,
    reviews,
    rules,
    store,
    streams,
    tables,
    texts,
)
from plumbline.plans.registry import REGISTRY  # noqa: F401
