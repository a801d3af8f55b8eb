"""Event table layout: raw envelope, payload fields and the typed silver columns."""

from pyspark.sql import types as T

# Event names, tool names and payload keys of the event format.
SESSION_START = "SessionStart"
SESSION_END = "SessionEnd"
PRE_COMPACT = "PreCompact"
PROMPT = "UserPromptSubmit"
STOP = "Stop"
SUBAGENT_STOP = "SubagentStop"
PRE_TOOL = "PreToolUse"
POST_TOOL = "PostToolUse"
TASK = "Task"
FILE_TOOLS = ("Read", "Write", "Edit", "MultiEdit")
EDIT_TOOLS = ("Edit", "MultiEdit")
WORKSPACE_KEY = "tmux_session"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("tool_arg", T.StringType()),
        T.StructField("matcher", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)


def _strings(*names):
    return [T.StructField(name, T.StringType()) for name in names]


# Every leaf is text: numbers are cast with try_cast afterwards, so one bad
# value nulls its own column instead of the whole record.
PAYLOAD_SCHEMA = T.StructType(
    _strings("session_id", "tool_name", "source", "cwd", WORKSPACE_KEY, "permission_mode")
    + [
        T.StructField(
            "tool_input",
            T.StructType(
                _strings(
                    "command", "file_path", "pattern", "url", "query", "description",
                    "old_string", "new_string", "subagent_type", "prompt",
                )
            ),
        ),
        T.StructField(
            "tool_response",
            T.StructType(
                [T.StructField("content", T.ArrayType(T.StructType(_strings("text"))))]
                + _strings("totalDurationMs", "totalTokens")
                + [T.StructField("token_usage", T.StructType(_strings("total_tokens")))]
            ),
        ),
    ]
)

SILVER_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_name", T.StringType()),
    ]
    + _strings(
        "session_id", "tool_name", "source", "cwd", "workspace", "permission_mode",
        "command", "file_path", "pattern", "url", "query", "description",
        "old_string", "new_string", "subagent_type", "prompt", "response_text",
    )
    + [
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("data", T.StringType()),
    ]
)

SILVER_COLUMNS = SILVER_SCHEMA.fieldNames()
# Everything but the JSON text.
TYPED_COLUMNS = [name for name in SILVER_COLUMNS if name != "data"]

# Display names of known agents.
AGENT_ALIASES = (
    ("athena-pr-reviewer", "PR-Review"),
    ("hermes-pr-courier", "PR-Courier"),
    ("heimdall-pr-guardian", "PR-Guard"),
    ("atlas-jira-analyst", "JIRA"),
    ("jira-analyst", "JIRA"),
    ("minerva-notion-oracle", "Notion"),
    ("test-validator", "Test-Val"),
    ("test-developer", "Test-Dev"),
    ("security-reviewer", "Security"),
    ("performance-reviewer", "Perf"),
    ("maintainability-reviewer", "Maint"),
    ("doc-generator", "Docs"),
    ("changelog-writer", "Changelog"),
    ("architect", "Arch"),
    ("backend-developer", "Backend"),
    ("frontend-developer", "Frontend"),
    ("database-developer", "Database"),
    ("context-analyzer", "Context"),
    ("requirements-clarifier", "Reqs"),
    ("pr-creator", "PR-Create"),
    ("story-analyzer", "Story"),
    ("agent-discoverer", "Discover"),
    ("task-planner", "Planner"),
    ("duplication-checker", "DupCheck"),
)

# Substrings of an agent name, tried in this order.
AGENT_CATEGORIES = (
    ("pr", ("pr", "PR")),
    ("review", ("review",)),
    ("jira", ("jira", "atlas")),
    ("test", ("test",)),
    ("security", ("security",)),
    ("doc", ("doc",)),
)
OTHER_CATEGORY = "other"
