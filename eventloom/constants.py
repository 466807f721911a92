"""Names shared by the mappings, sinks and readers."""

from __future__ import annotations

# The device identity written into CEF and UDM events.
VENDOR = "SETC"
PRODUCT = "setc"
PRODUCT_VERSION = "1.0"

# Formats in routing order with their relational table.
FORMAT_TABLES = {
    "zeek": "zeek_logs",
    "cim": "cim_logs",
    "ecs": "ecs_logs",
    "ocsf": "ocsf_logs",
    "cef": "cef_logs",
    "udm": "udm_logs",
}

# The one format whose events are text lines and not JSON.
TEXT_FORMAT = "cef"

# Formats a conversion makes, in the order they are written.
NORMALISED = ("cim", "ecs", "ocsf", "cef", "udm")

FAMILIES = ("http", "network", "process")
