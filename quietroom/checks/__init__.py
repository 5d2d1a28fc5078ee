"""Queries over the supplied tables, one per operator, with their SQL counterparts."""

from . import (  # noqa: F401
    entity_checks,
    list_checks,
    live_checks,
    report_checks,
    rule_checks,
    state_checks,
    text_checks,
)
from .base import ORACLE, QUERIES  # noqa: F401
