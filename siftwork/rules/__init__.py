"""Rules over fact tables and lines: a registry, a runner, suppressions and reports."""

from siftwork.rules.registry import RULES, Rule, lint
from siftwork.rules import build, correctness, performance, style  # noqa: F401  (they register their rules)

__all__ = ["RULES", "Rule", "lint"]
