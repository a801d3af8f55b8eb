"""Folders, moments and short events that several test modules share."""

from datetime import datetime, timedelta

SF_SMALL = "/root/testdata/sf0.001"
SF_MIDDLE = "/root/testdata/sf0.01"
T0 = datetime(2025, 9, 1, 10, 0, 0)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def task(side, agent="a", **more):
    return {
        "event_name": f"{side}ToolUse", "tool_name": "Task", "subagent_type": agent, **more,
    }
