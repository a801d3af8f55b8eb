"""Arguments the registered queries and their SQL oracles share.

The gaps between test events are hours long, so thresholds are wider here than
the defaults of the operators.
"""

AS_OF = "2024-01-31 00:00:00"
SESSION_ACTIVE = "12 hours"
OPEN_WITHIN = "1 day"
WORKSPACE_ACTIVE = "1 hour"
WORKSPACE_RECENT = "24 hours"
IDLE_S = 5_000
WAITING_S = 30_000
SIGNIFICANT_S = 60_000
SEVERITY_S = (100_000, 200_000)
BUCKETS_S = (2_000, 5_000, 60_000, 300_000)
WAIT_BOUNDS_S = (60_000, 300_000)
PARALLEL_GAP = "1 day"
PERIOD_GAP = "30000 seconds"
SILENCE = "12 hours"
PAIR_WITHIN = "10 days"
WATERMARK_DELAY = "10 minutes"
RANGE = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
SEARCH_TERMS = ("the", "data")
EVENT_TERMS = ("run 7", "done")
PRICES = (
    ("pr-creator", 0.5),
    ("code-reviewer", 0.25),
    ("test-validator", 0.125),
    ("security-reviewer", 1.0),
)
RULES = (
    (1, "PreToolUse", "Task"),
    (2, "PostToolUse", "Task"),
    (3, "SubagentStop", "*"),
    (4, "PreToolUse", "*"),
    (5, "PostToolUse", "Edit|Write"),
    (6, "SessionStart", "*"),
)
