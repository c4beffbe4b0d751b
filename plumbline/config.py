"""Options of a scan."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field


def option_list(text: str) -> list[str]:
    """Comma-separated entries, trimmed and in small letters, empty ones left out."""
    return [x for x in (part.strip().lower() for part in text.split(",")) if x]


def valid_ref(ref: str) -> bool:
    """Whether a revision name may be handed to the version-control command."""
    return bool(re.fullmatch(r"(?!-)[A-Za-z0-9._/@{}~^ \-]+", ref))


@dataclass(frozen=True)
class Config:
    """All options with their defaults."""

    fail_on: list[str] = field(default_factory=lambda: ["nullpointers"])
    max_complexity: int = 20
    max_cognitive: int = 15
    max_hotspot_score: float = math.inf
    skip_compile: bool = False
    verbose: bool = False
    top: int = 20
    min_commits: int = 1
    min_tokens: int = 50
    min_lines: int = 5
    legend: bool = True
    skip_patterns: list[str] = field(default_factory=list)
    compare_against: str | None = None
    as_of: int | None = None
