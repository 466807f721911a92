"""Process-table rows to CIM Endpoint, ECS, OCSF Process Query, CEF and UDM.

Fixed values: field names, constants and defaults of the five target schemas. The
fields ``process.start`` and ``created_time`` carry the CPU time, as the sources
of these tables have always been mapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.commands import with_command, with_shell_words
from eventloom.functions.scalars import epoch_millis
from eventloom.mappings.model import Mapping, computed, constant, or_now, take
from eventloom.mappings.shared import DEFAULT_IDENTITY, CefMapping, Identity, udm_metadata


def command_columns(cwd: str = "/"):
    """Preparation step: parts of COMMAND, and the words of the joined command."""

    def prepare(df: DataFrame) -> DataFrame:
        df = with_command(df, "COMMAND", "cmd", cwd)
        return with_shell_words(df, "cmd_fullcmd", "cmd_words")

    return prepare


_prepare = command_columns()

CIM = Mapping.of(
    [
        ("timestamp", or_now("ts")),
        ("action", constant("allowed")),
        ("cpu_load_percent", take("%CPU")),
        ("dest", constant("unknown")),
        ("mem_used", take("%MEM")),
        ("original_file_name", take("cmd_filename")),
        ("parent_process", constant("unknown")),
        ("parent_process_id", take("PPID")),
        ("parent_process_name", constant("unknown")),
        ("parent_process_path", constant("unknown")),
        ("process", take("cmd_fullcmd")),
        ("process_exec", take("cmd_abspath")),
        ("process_id", take("PID")),
        ("process_name", take("cmd_filename")),
        ("process_path", take("cmd_path")),
        ("user", take("USER")),
    ],
    _prepare,
)

ECS = Mapping.of(
    [
        ("@timestamp", or_now("ts")),
        ("ecs.version", constant("8.17")),
        ("event.kind", constant("event")),
        ("event.category", constant("process")),
        ("event.type", constant("info")),
        ("process.args", take("cmd_words")),
        ("process.args_count", computed(lambda r: F.array_size(r.column("cmd_words")))),
        ("process.command_line", take("cmd_fullcmd")),
        ("process.executable", take("cmd_abspath")),
        ("process.interactive", computed(lambda r: F.coalesce(r.column("TT"), F.lit("?")) != "?")),
        ("process.name", take("cmd_filename")),
        ("process.pgid", take("PGID")),
        ("process.pid", take("PID")),
        ("process.start", take("TIME")),
        ("process.tty", take("TT")),
        ("process.uptime", take("ELAPSED")),
        ("user", take("USER")),
    ],
    _prepare,
)

OCSF = Mapping.of(
    {
        "time": or_now("ts"),
        "activity_name": constant("query"),
        "activity_id": constant("1"),
        "category_uid": constant("5"),
        "category_name": constant("Discovery"),
        "class_uid": constant("5015"),
        "class_name": constant("Process Query"),
        "query_result": constant("Exists"),
        "query_result_id": constant("1"),
        "severity": constant("Informational"),
        "severity_id": constant("1"),
        "type_uid": constant("501599"),
        "type_name": constant("Process Query: Other"),
        "process": {
            "name": take("cmd_filename"),
            "pid": take("PID"),
            "session": {"terminal": take("TT")},
            "file": {
                "name": take("cmd_filename"),
                "type": constant("process"),
                "path": take("cmd_abspath"),
                "type_id": constant("99"),
                "parent_folder": take("cmd_path"),
            },
            "user": {"name": take("USER")},
            "cmd_line": take("cmd_fullcmd"),
            "created_time": take("TIME"),
        },
        "metadata": {
            "version": constant("1.4.0"),
            "product": {"name": constant("docker process logs")},
        },
    },
    _prepare,
)

_CEF_EXTENSIONS = Mapping.of(
    [
        ("rt", computed(lambda r: epoch_millis(or_now("ts")(r).typed), digits=True)),
        ("sproc", take("cmd_filename")),
        ("spid", take("PID")),
        ("dpid", take("PPID")),
        ("suser", take("USER")),
        ("act", constant("allowed")),
        ("cat", constant("process")),
        ("cs1Label", constant("commandLine")),
        ("cs1", take("cmd_fullcmd")),
        ("cs2Label", constant("executablePath")),
        ("cs2", take("cmd_abspath")),
        ("cs3Label", constant("tty")),
        ("cs3", take("TT")),
    ],
    _prepare,
)


def cef(identity: Identity = DEFAULT_IDENTITY) -> CefMapping:
    return CefMapping(
        identity,
        lambda r: F.lit(f"{identity.vendor}-PROC-SNAP"),
        lambda r: F.lit("Process Activity: Snapshot"),
        _CEF_EXTENSIONS,
    )


def udm(identity: Identity = DEFAULT_IDENTITY) -> Mapping:
    return Mapping.of(
        [
            *udm_metadata(or_now("ts"), "PROCESS_LAUNCH", identity),
            (("principal", "user", "userid"), take("USER")),
            (("target", "process", "pid"), take("PID")),
            (("target", "process", "parentProcess", "pid"), take("PPID")),
            (("target", "process", "commandLine"), take("cmd_fullcmd")),
            (("target", "process", "file", "full_path"), take("cmd_abspath")),
            (("security_result", "action"), constant("ALLOW")),
        ],
        _prepare,
    )
