"""All queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from panelforge.plans import q_accounts, q_learning, q_more, q_panel, q_pit, q_sources, q_semantics, q_strategy
from panelforge.plans.base import ORACLES, QUERIES

FLAGSHIP = "k4_factor_selection"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "q_accounts", "q_more", "q_panel", "q_pit", "q_sources", "q_strategy", "q_learning", "q_semantics"]
