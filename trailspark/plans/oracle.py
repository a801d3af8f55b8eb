"""DuckDB SQL for the registered queries, written independently of the operators."""

from trailspark.plans import parameters as P
from trailspark.schema import AGENT_ALIASES, TYPED_COLUMNS

# The fixture view over the ``events`` table.
VIEW = """
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST(json_extract_string(props, '$.k') AS INT) // 10 AS j
  FROM events),
named AS (
  SELECT *, CASE event_type
    WHEN 'signup' THEN CASE WHEN k < 50 THEN 'SessionStart' ELSE 'UserPromptSubmit' END
    WHEN 'view' THEN 'PreToolUse'
    WHEN 'click' THEN 'PostToolUse'
    WHEN 'purchase' THEN CASE WHEN k < 50 THEN 'PreToolUse' ELSE 'PostToolUse' END
    ELSE CASE WHEN k < 10 THEN 'SessionEnd' WHEN k < 20 THEN 'PreCompact'
              WHEN k < 30 THEN 'SubagentStop' ELSE 'Stop' END END AS event_name
  FROM base),
tooled AS (
  SELECT *, CASE WHEN event_name IN ('PreToolUse', 'PostToolUse') THEN
    (['Task','Task','Task','Bash','Read','Write','Edit','MultiEdit','Grep','WebFetch'])[k % 10 + 1] END AS tool_name
  FROM named),
ev AS (
  SELECT event_id, ts, event_name,
    's' || user_id || '-' || ((day(ts) - 1) // 10) AS session_id,
    tool_name,
    CASE WHEN event_name = 'SessionStart' THEN (['startup','resume','clear'])[k % 3 + 1] END AS source,
    '/home/u' || user_id || '/proj' || (k % 4) AS cwd,
    CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'w' || (user_id % 20) END AS workspace,
    'default' AS permission_mode,
    CASE WHEN tool_name = 'Bash' THEN 'cmd ' || j END AS command,
    CASE WHEN tool_name IN ('Read','Write','Edit','MultiEdit') THEN '/src/f' || j || '.py' END AS file_path,
    CASE WHEN tool_name = 'Grep' THEN 'pat' || j END AS pattern,
    CASE WHEN tool_name = 'WebFetch' THEN 'http://x/' || j END AS url,
    CAST(NULL AS VARCHAR) AS query,
    CASE WHEN tool_name = 'Task' THEN 'task ' || k END AS description,
    CASE WHEN tool_name IN ('Edit','MultiEdit') THEN repeat('a', k % 7 + 1) END AS old_string,
    CASE WHEN tool_name IN ('Edit','MultiEdit') THEN repeat('b', k % 11 + 1) END AS new_string,
    CASE WHEN tool_name = 'Task' THEN
      (['pr-creator','code-reviewer','test-validator','security-reviewer','doc-generator',NULL])[j % 6 + 1] END AS subagent_type,
    CASE WHEN tool_name = 'Task' AND event_name = 'PreToolUse' THEN 'run ' || k END AS prompt,
    CASE WHEN tool_name = 'Task' AND event_name = 'PostToolUse' THEN 'done ' || k END AS response_text,
    CASE WHEN tool_name = 'Task' AND event_name = 'PostToolUse' THEN CAST(floor(value * 100) AS DOUBLE) END AS duration_ms,
    CASE WHEN tool_name = 'Task' AND event_name = 'PostToolUse' THEN CAST(floor(value * 10) AS BIGINT) END AS total_tokens
  FROM tooled)"""

AGENT_PRE = "event_name = 'PreToolUse' AND tool_name = 'Task' AND subagent_type IS NOT NULL"
AGENT_POST = "event_name = 'PostToolUse' AND tool_name = 'Task' AND subagent_type IS NOT NULL"
IN_WS = "workspace IS NOT NULL AND workspace <> ''"
NOW = f"TIMESTAMP '{P.AS_OF}'"
COLUMNS = ", ".join(TYPED_COLUMNS)


def secs(start, end):
    return f"date_diff('microsecond', {start}, {end}) / 1e6"


def q(body, *ctes):
    return "WITH " + ",\n".join([VIEW.strip(), *ctes]) + "\n" + body


def values(rows):
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


AGENT_LISTS = f"""
first_use AS (
  SELECT session_id, subagent_type AS agent, min(ts) AS used_at FROM ev
  WHERE {AGENT_PRE} GROUP BY ALL),
lists AS (
  SELECT session_id, string_agg(agent, ',' ORDER BY used_at, agent) AS agents_list,
         count(*) AS unique_agents_count
  FROM first_use GROUP BY session_id)"""

ROLLUP = f"""
stats AS (
  SELECT session_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS total_events,
    count(DISTINCT tool_name) AS unique_tools,
    count(*) FILTER (event_name = 'SessionStart') AS start_events,
    count(*) FILTER (event_name = 'SessionEnd') AS end_events,
    max(CASE WHEN event_name = 'SessionStart' THEN source END) AS start_source,
    max(cwd) AS cwd, max(workspace) AS workspace,
    string_agg(DISTINCT tool_name, ', ' ORDER BY tool_name) AS tools_used
  FROM ev WHERE session_id IS NOT NULL GROUP BY session_id)"""

PROFILE = f"""
profile AS (
  SELECT subagent_type AS agent_type, count(*) AS total_invocations,
    count(DISTINCT session_id) AS unique_sessions, min(ts) AS first_used, max(ts) AS last_used,
    round_even(round(avg(duration_ms), 6), 0) AS avg_duration_ms,
    round_even(round(min(duration_ms), 6), 0) AS min_duration_ms,
    round_even(round(max(duration_ms), 6), 0) AS max_duration_ms,
    round_even(round(quantile_cont(duration_ms, 0.5), 6), 0) AS median_duration_ms,
    round_even(round(quantile_cont(duration_ms, 0.95), 6), 0) AS p95_duration_ms
  FROM ev WHERE {AGENT_POST} GROUP BY subagent_type)"""

WS_SESSIONS = f"""
ws_sessions AS (
  SELECT workspace, session_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS event_count
  FROM ev WHERE {IN_WS} GROUP BY ALL)"""

GAPS = f"""
gaps AS (
  SELECT *, lead(ts) OVER w AS next_ts, lead(tool_name) OVER w AS next_tool,
    date_diff('microsecond', ts, lead(ts) OVER w) AS gap_us
  FROM ev WHERE {IN_WS}
  WINDOW w AS (PARTITION BY workspace, session_id ORDER BY ts, event_id))"""

WORK_WAIT = f"""
turns AS (
  SELECT workspace, session_id, event_name,
    lead(event_name) OVER w AS next_event,
    date_diff('microsecond', ts, lead(ts) OVER w) AS us
  FROM ev
  WHERE {IN_WS} AND event_name IN ('SessionStart', 'UserPromptSubmit', 'Stop')
    AND (workspace, session_id) IN (SELECT (workspace, session_id) FROM ev WHERE event_name = 'Stop')
  WINDOW w AS (PARTITION BY workspace, session_id ORDER BY ts, event_id)),
split AS (
  SELECT workspace, session_id,
    CAST(sum(CASE WHEN event_name <> 'Stop' AND next_event = 'Stop' THEN us ELSE 0 END) AS BIGINT) AS work_us,
    CAST(sum(CASE WHEN event_name = 'Stop' AND next_event = 'UserPromptSubmit' THEN us ELSE 0 END) AS BIGINT) AS wait_us,
    count(*) FILTER (event_name = 'Stop') AS stop_count,
    count(*) FILTER (event_name = 'UserPromptSubmit') AS prompt_count
  FROM turns GROUP BY ALL),
waits AS (
  SELECT *, CASE WHEN work_us > 0 THEN stop_count ELSE 0 END AS active_periods,
    CAST(CASE WHEN wait_us > 0 AND wait_us <= {P.WAIT_BOUNDS_S[0]}e6 THEN 1 ELSE 0 END AS BIGINT) AS short_waits,
    CAST(CASE WHEN wait_us > {P.WAIT_BOUNDS_S[0]}e6 AND wait_us <= {P.WAIT_BOUNDS_S[1]}e6 THEN 1 ELSE 0 END AS BIGINT) AS medium_waits,
    CAST(CASE WHEN wait_us > {P.WAIT_BOUNDS_S[1]}e6 THEN 1 ELSE 0 END AS BIGINT) AS long_waits,
    CASE WHEN work_us + wait_us > 0 THEN work_us * 100.0::DOUBLE / (work_us + wait_us) ELSE 0.0::DOUBLE END AS active_percentage
  FROM split)"""


def paired(key, where, extra):
    """Numbered starts and ends, full outer joined."""
    side = (
        "SELECT *, row_number() OVER (PARTITION BY session_id, {key} ORDER BY ts, event_id) AS rn "
        "FROM (SELECT * REPLACE (coalesce(tool_name, 'Unknown') AS tool_name) FROM ev) "
        "WHERE {where} AND event_name = '{name}'"
    )
    pre = side.format(key=key, where=where, name="PreToolUse")
    post = side.format(key=key, where=where, name="PostToolUse")
    return f"""
pre AS ({pre}),
post AS ({post}),
calls AS (
  SELECT coalesce(pre.session_id, post.session_id) AS session_id,
    coalesce(pre.{key}, post.{key}) AS {key},
    coalesce(pre.rn, post.rn) AS call_no,
    coalesce(pre.ts, post.ts) AS start_time, post.ts AS end_time,
    coalesce(pre.event_id, post.event_id) AS call_id,
    date_diff('microsecond', pre.ts, post.ts) AS us,
    {extra}
  FROM pre FULL OUTER JOIN post
    ON pre.session_id = post.session_id AND pre.{key} = post.{key} AND pre.rn = post.rn)"""


AGENT_CALLS = paired(
    "subagent_type", "tool_name = 'Task' AND subagent_type IS NOT NULL",
    "coalesce(pre.description, post.description) AS description, post.total_tokens AS total_tokens",
)
TOOL_CALLS = paired(
    "tool_name", "true",
    "coalesce(pre.command, post.command) AS command, coalesce(pre.file_path, post.file_path) AS file_path",
)
GROUPS = f"""
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_time, call_id) AS execution_order,
    CASE WHEN start_time - lag(start_time) OVER (PARTITION BY session_id ORDER BY start_time, call_id)
      <= INTERVAL {P.PARALLEL_GAP} THEN 0 ELSE 1 END AS is_new
  FROM calls),
islands AS (
  SELECT *, CAST(sum(is_new) OVER (PARTITION BY session_id ORDER BY start_time) AS BIGINT) AS group_id FROM flagged),
grouped AS (
  SELECT session_id, subagent_type AS agent_type, description, start_time, end_time,
    us / 1e6 AS duration_seconds, us, total_tokens, execution_order, group_id,
    count(*) OVER (PARTITION BY session_id, group_id) AS group_size,
    row_number() OVER (PARTITION BY session_id, group_id ORDER BY start_time, call_id) AS position_in_group
  FROM islands)"""


def search(table, id_columns, terms, text="text"):
    hits = " + ".join(
        f"(length(l) - length(replace(l, '{t.lower()}', ''))) // {len(t)}" for t in terms
    )
    first = ", ".join(f"nullif(strpos(l, '{t.lower()}'), 0)" for t in terms)
    return f"""
texts AS (SELECT {id_columns}, {text} AS t, lower({text}) AS l FROM {table}),
found AS (SELECT *, CAST({hits} AS BIGINT) AS hits, least({first}) AS pos FROM texts)"""


ORACLE = {
    # sessions
    "latest_session": q("SELECT session_id, ts FROM ev ORDER BY ts DESC, event_id DESC LIMIT 1"),
    "session_lifecycle": q(
        "SELECT session_id, ts, event_name, source FROM ev "
        "WHERE event_name IN ('SessionStart', 'SessionEnd', 'PreCompact')"
    ),
    "session_tool_stats": q(
        "SELECT session_id, coalesce(tool_name, 'Unknown') AS tool_name, "
        "count(*) FILTER (event_name = 'PreToolUse') AS pre_count, "
        "count(*) FILTER (event_name = 'PostToolUse') AS post_count, "
        "count(DISTINCT command) AS unique_commands, count(DISTINCT file_path) AS unique_files "
        "FROM ev WHERE event_name IN ('PreToolUse', 'PostToolUse') GROUP BY 1, 2"
    ),
    "recent_timeline": q(
        "SELECT session_id, ts, event_name, tool_name, command, file_path, pattern, url, description FROM ev "
        "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 100"
    ),
    "file_operations": q(
        "SELECT ts, tool_name, file_path, event_name FROM ev "
        "WHERE tool_name IN ('Read', 'Write', 'Edit', 'MultiEdit') AND file_path IS NOT NULL "
        "ORDER BY ts DESC, event_id DESC LIMIT 50"
    ),
    "session_rollup": q(
        f"""SELECT s.*, CASE WHEN end_events > 0 THEN 'completed'
              WHEN session_end > {NOW} - INTERVAL {P.SESSION_ACTIVE} THEN 'active' ELSE 'inactive' END AS status,
            coalesce(agents_list, '') AS agents_used, coalesce(unique_agents_count, 0) AS unique_agents,
            {secs('session_start', 'session_end')} AS duration_seconds
            FROM stats s LEFT JOIN lists USING (session_id)""",
        ROLLUP, AGENT_LISTS,
    ),
    "session_agent_list": q("SELECT * FROM lists", AGENT_LISTS),
    "active_sessions": q(
        f"""SELECT session_id, session_start, session_end AS last_event, total_events, cwd, workspace,
            {secs('session_end', NOW)} AS seconds_since_last, coalesce(agents_list, '') AS agents_used,
            {secs('session_start', 'session_end')} AS duration_seconds
            FROM stats LEFT JOIN lists USING (session_id)
            WHERE end_events = 0 AND {secs('session_end', NOW)} < 86400
            ORDER BY session_end DESC, session_id LIMIT 10""",
        ROLLUP, AGENT_LISTS,
    ),
    "session_timeline": q(f"SELECT {COLUMNS} FROM ev"),
    "session_context": q(
        "SELECT session_id AS session, max(cwd) AS working_dir, max(workspace) AS workspace, "
        "count(*) AS events, max(ts) AS last_event FROM ev GROUP BY 1"
    ),
    "recent_events": q(f"SELECT {COLUMNS} FROM ev ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 50"),
    "recent_sessions": q(
        f"""SELECT session_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS total_events,
            {secs('min(ts)', 'max(ts)')} AS duration_seconds FROM ev GROUP BY 1
            ORDER BY session_start DESC, session_id LIMIT 20 OFFSET 10"""
    ),
    "events_between": q(
        f"SELECT {COLUMNS} FROM ev WHERE ts >= TIMESTAMP '{P.RANGE[0]}' AND ts < TIMESTAMP '{P.RANGE[1]}'"
    ),
    "session_replay": q(
        f"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS step, ts,
            {secs('min(ts) OVER (PARTITION BY session_id)', 'ts')} AS offset_seconds, event_name, tool_name FROM ev"""
    ),
    # tools
    "tool_usage": q(
        "SELECT tool_name AS tool, count(*) AS usage_count FROM ev WHERE event_name = 'PreToolUse' GROUP BY 1"
    ),
    "pair_tool_calls": q(
        "SELECT session_id, tool_name, call_no, start_time, end_time, us / 1e6 AS duration_seconds, "
        "command, file_path FROM calls", TOOL_CALLS,
    ),
    "edit_changes": q(
        """SELECT session_id, ts, file_path, length(old_string) AS old_len, length(new_string) AS new_len,
           length(new_string) - length(old_string) AS delta_chars,
           row_number() OVER (PARTITION BY session_id, file_path ORDER BY ts, event_id) AS edits_to_file
           FROM ev WHERE tool_name IN ('Edit', 'MultiEdit') AND event_name = 'PostToolUse'"""
    ),
    "event_timeseries": q(
        "SELECT date_trunc('hour', ts) AS bucket_start, event_name, count(*) AS events FROM ev GROUP BY 1, 2"
    ),
    "search_text": "WITH "
    + search("conversations", "conv_id, turn, role", P.SEARCH_TERMS).strip()
    + " SELECT conv_id, turn, role, hits, substr(t, greatest(pos - 20, 1), 80) AS snippet FROM found WHERE hits > 0",
    "search_documents": "WITH "
    + search("documents", "doc_id, lang, source", P.SEARCH_TERMS).strip()
    + " SELECT doc_id, lang, source, hits, substr(t, greatest(pos - 20, 1), 80) AS snippet FROM found WHERE hits > 0",
    "search_indexed_documents": "WITH "
    + search("documents", "doc_id, lang, source", P.SEARCH_TERMS).strip()
    + " SELECT doc_id, lang, source, hits, substr(t, greatest(pos - 20, 1), 80) AS snippet FROM found WHERE hits > 0",
    "search_event_texts": q(
        "SELECT id, role, ts, hits, substr(t, greatest(pos - 20, 1), 80) AS snippet FROM found WHERE hits > 0",
        """spoken AS (
             SELECT event_id AS id, 'prompt' AS role, ts, prompt AS text FROM ev WHERE prompt IS NOT NULL
             UNION ALL
             SELECT event_id, 'response', ts, response_text FROM ev WHERE response_text IS NOT NULL)""",
        search("spoken", "id, role, ts", P.EVENT_TERMS),
    ),
    # agents
    "window_stats": q(
        f"""SELECT span, count(*) FILTER (inside) AS total_events,
              count(DISTINCT workspace) FILTER (inside AND {IN_WS}) AS unique_workspaces,
              count(DISTINCT subagent_type) FILTER (inside AND {AGENT_PRE}) AS unique_agents
            FROM (SELECT ev.*, s.span, ts >= {NOW} - s.len AS inside FROM ev,
                  (VALUES ('7 days', INTERVAL 7 DAY), ('24 hours', INTERVAL 24 HOUR)) s(span, len))
            GROUP BY span"""
    ),
    "agent_usage": q(
        f"""SELECT subagent_type AS agent_type, count(*) AS usage_count, count(DISTINCT session_id) AS sessions_used,
            min(ts) AS first_used, max(ts) AS last_used FROM ev WHERE {AGENT_PRE} GROUP BY 1"""
    ),
    "agent_duration_profile": q("SELECT * FROM profile", PROFILE),
    "duration_range_shares": q(
        """SELECT agent_type, width AS range_ms,
             round((median_duration_ms - min_duration_ms) / nullif(width, 0) * 100, 6) AS share_0_50,
             round((p95_duration_ms - median_duration_ms) / nullif(width, 0) * 100, 6) AS share_50_95,
             round((max_duration_ms - p95_duration_ms) / nullif(width, 0) * 100, 6) AS share_95_100,
             round((avg_duration_ms - min_duration_ms) / nullif(width, 0) * 100, 6) AS avg_position
           FROM (SELECT *, max_duration_ms - min_duration_ms AS width FROM profile)""",
        PROFILE,
    ),
    "agent_recent_invocations": q(
        f"""SELECT subagent_type AS agent_type, ts, session_id, description, cwd, workspace FROM ev WHERE {AGENT_PRE}
            QUALIFY row_number() OVER (PARTITION BY subagent_type ORDER BY ts DESC, event_id DESC) <= 50"""
    ),
    "agent_sessions": q(
        f"""SELECT a.agent_type, s.session_id, session_start, session_end, total_events, cwd, workspace,
              {secs('session_start', 'session_end')} AS duration_seconds
            FROM (SELECT DISTINCT subagent_type AS agent_type, session_id FROM ev WHERE {AGENT_PRE}) a
            JOIN stats s USING (session_id)
            QUALIFY row_number() OVER (PARTITION BY a.agent_type ORDER BY session_end DESC, s.session_id) <= 20""",
        ROLLUP,
    ),
    "pair_agent_calls": q(
        "SELECT session_id, subagent_type AS agent_type, description, start_time, end_time, "
        "us / 1e6 AS duration_seconds, total_tokens, call_no, us < 0 AS is_out_of_order FROM calls",
        AGENT_CALLS,
    ),
    "parallel_groups": q(
        "SELECT * EXCLUDE (us), group_size > 1 AS is_parallel FROM grouped", AGENT_CALLS, GROUPS
    ),
    "session_agent_summary": q(
        """SELECT * FROM
           (SELECT session_id, count(DISTINCT subagent_type) AS unique_agents,
              count(DISTINCT subagent_type || event_name) FILTER (event_name IN ('PreToolUse', 'PostToolUse')) AS distinct_agent_events
            FROM ev WHERE tool_name = 'Task' AND subagent_type IS NOT NULL GROUP BY 1)
           JOIN (SELECT session_id, count(*) AS total_invocations,
              CAST(sum(us) AS BIGINT) / 1e6 / count(us) AS avg_duration_seconds,
              count(DISTINCT CASE WHEN group_size > 1 THEN group_id END) AS parallel_groups
            FROM grouped GROUP BY 1) USING (session_id)""",
        AGENT_CALLS, GROUPS,
    ),
    "summary": q(
        "SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions, "
        "count(DISTINCT subagent_type) AS unique_agents FROM ev"
    ),
    "agent_performance": q(
        f"""SELECT subagent_type AS agent_type, count(*) AS invocations, round(avg(duration_ms), 3) AS avg_duration_ms,
            CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(total_tokens), 3) AS avg_tokens
            FROM ev WHERE {AGENT_POST} GROUP BY 1"""
    ),
    "token_cost": q(
        f"""SELECT session_id, agent_type, total_tokens, round(total_tokens * usd_per_1k_tokens / 1000, 6) AS cost
            FROM (SELECT session_id, subagent_type AS agent_type, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
                  FROM ev WHERE {AGENT_POST} GROUP BY 1, 2)
            LEFT JOIN (SELECT agent_type, CAST(p AS DOUBLE) AS usd_per_1k_tokens
                       FROM (VALUES {values(P.PRICES)}) t(agent_type, p)) USING (agent_type)"""
    ),
    "agent_category_usage": q(
        f"""SELECT CASE WHEN contains(a, 'pr') OR contains(a, 'PR') THEN 'pr' WHEN contains(a, 'review') THEN 'review'
              WHEN contains(a, 'jira') OR contains(a, 'atlas') THEN 'jira' WHEN contains(a, 'test') THEN 'test'
              WHEN contains(a, 'security') THEN 'security' WHEN contains(a, 'doc') THEN 'doc' ELSE 'other' END AS category,
            count(*) AS usage_count, count(DISTINCT a) AS agents
            FROM (SELECT subagent_type AS a FROM ev WHERE {AGENT_PRE}) GROUP BY 1"""
    ),
    "agent_alias_usage": q(
        f"""SELECT coalesce(short_name, split_part(subagent_type, '-', 1)) AS short_name, count(*) AS usage_count
            FROM ev LEFT JOIN (VALUES {values(AGENT_ALIASES)}) t(agent_type, short_name) ON subagent_type = agent_type
            WHERE {AGENT_PRE} GROUP BY 1"""
    ),
    "project_usage": q(
        """SELECT split_part(cwd, '/', -2) || '/' || split_part(cwd, '/', -1) AS project,
           count(DISTINCT session_id) AS sessions, count(*) AS events, max(ts) AS last_event FROM ev GROUP BY 1"""
    ),
    # workspaces
    "workspace_rollup": q(
        f"""SELECT workspace, count(*) AS total_sessions, min(start_time) AS first_activity,
              max(end_time) AS last_activity, CAST(sum(event_count) AS BIGINT) AS total_events,
              CAST(sum(date_diff('microsecond', start_time, end_time)) AS BIGINT) / 1e6 AS total_duration_seconds,
              CASE WHEN max(end_time) > {NOW} - INTERVAL {P.WORKSPACE_ACTIVE} THEN 'active'
                   WHEN max(end_time) > {NOW} - INTERVAL {P.WORKSPACE_RECENT} THEN 'recent' ELSE 'inactive' END AS status
            FROM ws_sessions GROUP BY 1""",
        WS_SESSIONS,
    ),
    "workspace_session_ids": q("SELECT workspace, session_id FROM ws_sessions", WS_SESSIONS),
    "workspace_avg_session": q(
        """SELECT workspace, CAST(sum(date_diff('microsecond', start_time, end_time)) AS BIGINT) / 1e6 / count(*) AS avg_session_seconds
           FROM ws_sessions GROUP BY 1""",
        WS_SESSIONS,
    ),
    "workspace_sessions": q(
        f"SELECT *, {secs('start_time', 'end_time')} AS duration_seconds FROM ws_sessions", WS_SESSIONS
    ),
    # activity
    "activity_states": q(
        f"""SELECT workspace, session_id, ts, event_name, tool_name, description, command, file_path, next_ts,
              gap_us / 1e6 AS gap_seconds,
              CASE WHEN next_ts IS NULL THEN 'session_end' WHEN gap_us > {P.WAITING_S}e6 THEN 'waiting'
                   WHEN gap_us > {P.IDLE_S}e6 THEN 'idle' ELSE 'active' END AS activity_state
            FROM gaps""",
        GAPS,
    ),
    "significant_gaps": q(
        f"""SELECT workspace, session_id, ts AS gap_start, next_ts AS gap_end, gap_us / 1e6 AS gap_seconds,
              tool_name AS last_tool, next_tool,
              CASE WHEN gap_us < {P.SEVERITY_S[0]}e6 THEN 'minor' WHEN gap_us < {P.SEVERITY_S[1]}e6 THEN 'moderate'
                   ELSE 'major' END AS severity
            FROM gaps WHERE gap_us > {P.SIGNIFICANT_S}e6
            QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY gap_us DESC, ts, event_id) <= 50""",
        GAPS,
    ),
    "gap_histogram": q(
        f"""SELECT workspace, CASE WHEN gap_us <= {P.BUCKETS_S[0]}e6 THEN 'active' WHEN gap_us <= {P.BUCKETS_S[1]}e6 THEN 'idle'
              WHEN gap_us <= {P.BUCKETS_S[2]}e6 THEN 'short_wait' WHEN gap_us <= {P.BUCKETS_S[3]}e6 THEN 'medium_wait'
              ELSE 'long_wait' END AS bucket, count(*) AS gaps, CAST(sum(gap_us) AS BIGINT) / 1e6 AS gap_seconds
            FROM gaps WHERE next_ts IS NOT NULL GROUP BY 1, 2""",
        GAPS,
    ),
    "work_wait_split": q(
        """SELECT workspace, session_id, work_us / 1e6 AS working_time_seconds, wait_us / 1e6 AS waiting_time_seconds,
           (work_us + wait_us) / 1e6 AS total_time_seconds, active_percentage, stop_count, prompt_count FROM waits""",
        WORK_WAIT,
    ),
    "wait_profile": q(
        """SELECT workspace, session_id, active_periods, short_waits, medium_waits, long_waits,
           wait_us / 1e6 AS longest_gap_seconds, wait_us / 1e6 / stop_count AS avg_gap_seconds,
           true AS has_accurate_data FROM waits""",
        WORK_WAIT,
    ),
    "workspace_activity": q(
        """SELECT workspace, count(*) AS sessions, CAST(sum(work_us) AS BIGINT) / 1e6 AS active_time_seconds,
             CAST(sum(wait_us) AS BIGINT) / 1e6 AS waiting_time_seconds, max(wait_us) / 1e6 AS longest_gap_seconds,
             CAST(sum(short_waits) AS BIGINT) AS short_waits, CAST(sum(medium_waits) AS BIGINT) AS medium_waits,
             CAST(sum(long_waits) AS BIGINT) AS long_waits,
             CAST(sum(work_us) AS BIGINT) * 100.0::DOUBLE / nullif(CAST(sum(work_us + wait_us) AS BIGINT), 0) AS active_percentage,
             CAST(sum(wait_us) AS BIGINT) * 100.0::DOUBLE / nullif(CAST(sum(work_us + wait_us) AS BIGINT), 0) AS waiting_percentage
           FROM waits GROUP BY 1""",
        WORK_WAIT,
    ),
    "session_activity_share": q(
        f"""SELECT s.*, {secs('start_time', 'end_time')} AS duration_seconds, active_percentage,
            active_percentage IS NOT NULL AS has_accurate_data
            FROM ws_sessions s LEFT JOIN waits USING (workspace, session_id)""",
        WS_SESSIONS, WORK_WAIT,
    ),
}

RULES = " UNION ALL ".join(
    f"SELECT event_id, event_name, tool_name, {rule_id} AS rule_id FROM ev WHERE event_name = '{name}'"
    + ("" if pattern == "*" else f" AND regexp_matches(tool_name, '{pattern}')")
    for rule_id, name, pattern in P.RULES
)

ORACLE.update({
    # sources and sinks
    "read_raw_events": q(
        "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_name, '' AS tool_arg, "
        "'*' AS matcher, session_id FROM ev"
    ),
    "normalize_time": """SELECT event_id, date_trunc('second', CASE event_type
        WHEN 'click' THEN ts + INTERVAL 3 HOUR WHEN 'view' THEN ts ELSE ts + INTERVAL 5 HOUR END) AS ts FROM events""",
    "split_quarantine": """SELECT event_id, CASE WHEN trim(data) = '' THEN 'no_data'
        WHEN NOT json_valid(data) THEN 'invalid_json' END AS reason
        FROM (SELECT event_id, CASE event_type WHEN 'error' THEN substr(props, 1, length(props) - 1)
              WHEN 'view' THEN ' ' ELSE props END AS data FROM events)""",
    "to_silver": q(f"SELECT {COLUMNS} FROM ev"),
    "attach_workspace": q(
        """SELECT event_id, cwd, coalesce(label, workspace) AS workspace,
              coalesce(label, workspace) AS payload_workspace
            FROM (SELECT *, CASE WHEN u % 3 <> 0 THEN 'h' || (u % 5) END AS label
                  FROM (SELECT *, CAST(regexp_extract(cwd, 'u([0-9]+)/', 1) AS INTEGER) AS u FROM ev))"""
    ),
    "append_events": q(f"SELECT CAST(ts AS DATE) AS event_date, {COLUMNS} FROM ev"),
    "write_audit_log": q("SELECT event_name, count(*) AS entries FROM ev GROUP BY 1"),
    "agent_event_feed": q(
        """SELECT event_date, row_number() OVER (PARTITION BY event_date ORDER BY ts, event_id) AS id,
             event_id, ts, phase
           FROM (SELECT CAST(ts AS DATE) AS event_date, event_id, ts,
                   CASE WHEN event_name = 'PreToolUse' AND tool_name = 'Task' THEN 'pre'
                        WHEN event_name = 'PostToolUse' AND tool_name = 'Task' THEN 'post'
                        WHEN event_name = 'SubagentStop' THEN 'stop' END AS phase FROM ev)
           WHERE phase IS NOT NULL"""
    ),
    "heartbeat_rate": """SELECT bucket_start, count(*) AS beats, max(gap) AS max_gap_s
        FROM (SELECT date_trunc('day', s)::TIMESTAMP AS bucket_start,
                date_diff('second', lag(s) OVER (PARTITION BY date_trunc('day', s) ORDER BY s), s) AS gap
              FROM (SELECT date_trunc('second', ts) AS s FROM events))
        GROUP BY 1""",
    "route_events": q(RULES),
    "export_csv": ORACLE["session_rollup"],
    # streams
    "stream_silver": q(
        f"""SELECT * EXCLUDE (event_id) REPLACE (date_trunc('second', ts) AS ts) FROM (
              SELECT {COLUMNS} FROM ev UNION ALL
              SELECT {COLUMNS} FROM ev WHERE event_name = 'PostToolUse' AND event_id % 2 = 1)"""
    ),
    "stream_session_rollup": q(
        """SELECT session_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS total_events,
             count(*) FILTER (event_name = 'SessionEnd') AS end_events,
             count(*) FILTER (event_name = 'SessionEnd') > 0 AS is_ended
           FROM ev GROUP BY 1"""
    ),
    "stream_active_sessions": q(
        f"""SELECT session_id, CASE WHEN ends > 0 OR is_silent THEN 'closed' ELSE 'open' END AS state,
             CASE WHEN ends > 0 THEN 'end' WHEN is_silent THEN 'silence' END AS reason,
             session_start, last_event, events, {secs('session_start', 'last_event')} AS duration_seconds
           FROM (SELECT session_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events,
                   count(*) FILTER (event_name = 'SessionEnd') AS ends,
                   max(ts) + INTERVAL {P.SILENCE} < (SELECT max(ts) FROM ev) - INTERVAL {P.WATERMARK_DELAY} AS is_silent
                 FROM ev GROUP BY 1)"""
    ),
    "stream_pair_calls": q(
        """SELECT coalesce(pre.session_id, post.session_id) AS session_id,
             coalesce(pre.subagent_type, post.subagent_type) AS agent_type,
             coalesce(pre.session_id, post.session_id) || '|' || coalesce(pre.subagent_type, post.subagent_type)
               || '|' || coalesce(pre.rn, post.rn) AS call_key,
             pre.ts AS start_time, post.ts AS end_time,
             date_diff('microsecond', pre.ts, post.ts) / 1e6 AS duration_seconds, post.total_tokens
           FROM pre FULL JOIN post
             ON pre.session_id = post.session_id AND pre.subagent_type = post.subagent_type AND pre.rn = post.rn""",
        AGENT_CALLS,
    ),
    "stream_window_counts": """WITH hourly AS (
          SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1)
        SELECT '1 hour' AS span, hour AS window_start, n AS events FROM hourly
        UNION ALL
        SELECT '24 hours', hour - to_hours(h), CAST(sum(n) AS BIGINT) FROM hourly, range(24) r(h) GROUP BY 1, 2""",
    "stream_activity_periods": q(
        """SELECT session_id, min(ts) AS period_start, max(ts) AS period_end, count(*) AS events,
             date_diff('microsecond', min(ts), max(ts)) / 1e6 AS active_seconds
           FROM (SELECT session_id, ts, sum(is_new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS period
                 FROM breaks) GROUP BY session_id, period""",
        f"""breaks AS (
          SELECT session_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)
            <= INTERVAL {P.PERIOD_GAP} THEN 0 ELSE 1 END AS is_new FROM ev)""",
    ),
    "stream_late_report": """SELECT date_trunc('hour', ts) AS hour, count(*) AS late_events,
          max(minute(ts)) * 120.0::DOUBLE AS longest_delay_seconds
        FROM events WHERE minute(ts) * 2 > 60 GROUP BY 1""",
})

# The same results from stored counts.
for name in ("session_rollup", "workspace_rollup", "tool_usage", "summary"):
    ORACLE[f"{name}_of_cube"] = ORACLE[name]
ORACLE["route_events_by"] = ORACLE["route_events"]
# A page found by counting.
ORACLE["events_page"] = q(f"SELECT {COLUMNS} FROM ev ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 400")
