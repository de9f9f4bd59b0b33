"""Engine settings (the global section of a config file)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Limits and defaults of the scoring model.
U32_MAX = 4294967295
DEFAULT_BLOCK_SCORE = 10
DEFAULT_MULTIPLIER = 3600
DEFAULT_FEED_BLOCK_SCORE = 90
MIN_FEED_SCORE = 25
MAX_FEED_SCORE = 100
DEFAULT_CATEGORY = 15
REPORT_GAP_SECONDS = 900
COMMENT_LIMIT = 1500
DEFAULT_RULE_TEMPLATE = "-s %i -j DROP"
DEFAULT_DATE_FORMAT = "%Y-%m-%d %H:%M:%S"
CHECK_INTERVAL_SECONDS = 30
SYNC_RETRY_SECONDS = 300
REMOVED_ROWS_BEFORE_COMPACTION = 1000


@dataclass(frozen=True)
class Settings:
    """Global settings; ``multiplier = 0`` switches score decay off."""

    block_score: int = DEFAULT_BLOCK_SCORE
    multiplier: int = DEFAULT_MULTIPLIER
    feed_block_score: int = DEFAULT_FEED_BLOCK_SCORE
    report_all: bool = False
    report_mask: bool = True
    default_categories: tuple[int, ...] = (DEFAULT_CATEGORY,)
    default_comment: str | None = None
    reporting_enabled: bool = True
    date_format: str = DEFAULT_DATE_FORMAT
    rule_template: str = DEFAULT_RULE_TEMPLATE
    append_rules: bool = False
    check_interval: int = CHECK_INTERVAL_SECONDS
    feed_interval: int = 0
    extra: dict[str, str] = field(default_factory=dict, compare=False)

    @property
    def block_threshold(self) -> int:
        """Score an address must exceed: block score in multiplier units."""
        return self.block_score * self.multiplier if self.multiplier > 0 else self.block_score
