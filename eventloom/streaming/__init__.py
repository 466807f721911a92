"""Structured Streaming jobs."""

from eventloom.streaming.jobs import (
    alert_once,
    monitor_layout,
    read_alerts,
    read_log_stream,
    route_batches,
)
from eventloom.streaming.state import STATE_STORE, alert_from_state, raised_alerts

__all__ = [
    "STATE_STORE",
    "alert_from_state",
    "alert_once",
    "monitor_layout",
    "raised_alerts",
    "read_alerts",
    "read_log_stream",
    "route_batches",
]
