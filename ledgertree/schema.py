"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

MUTATION_LOG = _schema(
    sequence=_L, volume=_S, file_id=_L, parent_file_id=_L, name=_S, kind=_S,
    is_directory=_B, size_delta=_L, at=_TS, source=_S, observed_size=_L, attributes=_I,
)
FACTS = _schema(
    volume=_S, file_id=_L, parent_file_id=_L, name=_S, is_directory=_B, size=_L,
    created_at=_TS, modified_at=_TS, attributes=_I,
)
DRAIN_STATE = _schema(volume=_S, last_sequence=_L)
PRUNING_LOG = _schema(volume=_S, run_at=_TS, status=_S, details=_S)
PARENT_SNAPSHOTS = _schema(
    id=_S, label=_S, created_at=_TS, daemon_version=_S, schema_version=_L, retention_setting=_S
)
VOLUME_SNAPSHOTS = _schema(id=_S, parent_id=_S, volume=_S, sequence_number=_L, facts_count=_L)
APP_INSTALL_FOOTPRINTS = _schema(app_name=_S, file_path=_S, install_time=_TS)
APP_RUNTIME_ARTIFACTS = _schema(process_name=_S, target_path=_S, access_time=_TS)
SESSIONS = _schema(session_id=_S, first_question=_S, created_at=_TS, state_json=_S)
CHECKPOINTS = _schema(
    id=_S, ts=_TS, thread_id=_S, step=_L,
    channel_values=T.MapType(_S, _S), channel_versions=T.MapType(_S, _L),
)
VOLUME_STATES = _schema(volume=_S, state=_S, replaying=_B)
RAW_CHANGES = _schema(
    usn=_L, volume=_S, file_ref=_L, parent_ref=_L, name=_S, reason=_I, attributes=_I, at=_TS
)

TABLES: dict[str, T.StructType] = {
    "mutation_log": MUTATION_LOG,
    "facts": FACTS,
    "drain_state": DRAIN_STATE,
    "pruning_log": PRUNING_LOG,
    "parent_snapshots": PARENT_SNAPSHOTS,
    "volume_snapshots": VOLUME_SNAPSHOTS,
    "app_install_footprints": APP_INSTALL_FOOTPRINTS,
    "app_runtime_artifacts": APP_RUNTIME_ARTIFACTS,
    "sessions": SESSIONS,
    "checkpoints": CHECKPOINTS,
}

# Change kinds, in the order the reason bits are tested.
DELETED, CREATED, RENAMED, MODIFIED = "Deleted", "Created", "Renamed", "Modified"

# Attribute bits.
READONLY, HIDDEN, SYSTEM, DIRECTORY, ARCHIVE, REPARSE = 1, 2, 4, 16, 32, 1024

# Volume states.
LIVE = "Live"
