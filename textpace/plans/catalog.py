"""All registered queries."""

from textpace.plans import activity, layout, markdown, packages, reading, structure, web  # noqa: F401
from textpace.plans.registry import ORACLES, QUERIES  # noqa: F401
