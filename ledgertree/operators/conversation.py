"""Conversation, checkpoint and channel-write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgertree.operators.ordered import CHUNK_ROWS, Ordered
from ledgertree.session import materialize

# When a question is shortened, to what length, and the round limit.
QUESTION_MAX, QUESTION_CUT, MAX_ROUNDS = 60, 57, 12
# Tools that change something and need approval.
MUTATING_TOOLS = ("cli_write_command", "snapshot_manage", "snapshot_create", "snapshot_delete")


def list_sessions(turns: DataFrame) -> DataFrame:
    """One row per conversation: shortened first question and number of turns."""
    first = turns.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("q"),
        F.count("*").alias("turns"),
    )
    short = F.when(
        F.length("q") > QUESTION_MAX, F.concat(F.substring("q", 1, QUESTION_CUT), F.lit("..."))
    ).otherwise(F.col("q"))
    return first.select("conv_id", short.alias("first_question"), "turns")


def newest_sessions(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = sessions.orderBy(F.desc("created_at"), F.desc("session_id"))
    return ordered if limit is None else ordered.limit(limit)


def transcript(turns: DataFrame) -> DataFrame:
    """Turns to display, without system ones; one row each, so length does not matter."""
    return turns.filter(F.col("role") != "system").select(
        "conv_id",
        "turn",
        F.when(F.col("role").isin("user", "assistant", "tool"), F.initcap("role")).otherwise(F.col("role")).alias("speaker"),
        "text",
    )


def audit_tool_calls(messages: DataFrame) -> DataFrame:
    """Tool calls of assistants that no tool message answers.

    ``messages``: conv_id, turn, role, tool_calls (array of id, name,
    arguments), tool_call_id.
    """
    made = messages.filter(F.col("role") == "assistant").select(
        "conv_id", F.explode("tool_calls").alias("c")
    ).select("conv_id", F.col("c.id").alias("tool_call_id"))
    answered = messages.filter(F.col("role") == "tool").select("conv_id", "tool_call_id")
    return made.distinct().join(answered, ["conv_id", "tool_call_id"], "left_anti")


def route(
    messages: DataFrame, interactive: bool = True, mutating: tuple[str, ...] = MUTATING_TOOLS
) -> DataFrame:
    """Where each conversation goes next: tools, approval, reject or end."""
    calls = F.coalesce(F.size("tool_calls"), F.lit(0)) > 0
    writes = F.exists("tool_calls", lambda c: c["name"].isin(list(mutating)))
    last = messages.groupBy("conv_id").agg(
        F.max_by(F.struct(calls.alias("calls"), writes.alias("writes")), "turn").alias("l"),
        F.count_if(F.col("role") == "assistant").alias("rounds"),
    )
    step = (
        F.when(F.col("rounds") >= MAX_ROUNDS, F.lit("end"))
        .when(~F.col("l.calls"), F.lit("end"))
        .when(F.coalesce("l.writes", F.lit(False)), F.lit("approval" if interactive else "reject"))
        .otherwise(F.lit("tools"))
    )
    return last.select("conv_id", "rounds", step.alias("route"))


# --- channel writes ------------------------------------------------------------------------

_CHANNEL = ["thread_id", "channel"]


def reduce_scalars(writes: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Value of each (thread, channel) under its rule: last, sum, max, min or ephemeral.

    All rules are computed in one partially combined aggregate. An ephemeral
    value exists only if written in the thread's latest step.
    """
    rule = _rule(rules)
    sums = writes.groupBy(*_CHANNEL).agg(
        F.max_by("value", F.struct("step", *_ties(writes))).alias("last"), F.sum("value").alias("sum"), F.max("value").alias("max"),
        F.min("value").alias("min"), F.max("step").alias("step"),
    )
    now = sums.groupBy("thread_id").agg(F.max("step").alias("now"))
    both = sums.join(now, "thread_id")
    value = F.lit(None).cast("long")
    for name in ("last", "sum", "max", "min"):
        value = F.when(F.col("rule") == name, F.col(name)).otherwise(value)
    value = F.when(F.col("rule") == "ephemeral", F.when(F.col("step") == F.col("now"), F.col("last"))).otherwise(value)
    return (
        both.withColumn("rule", rule)
        .filter(F.col("rule").isin("last", "sum", "max", "min", "ephemeral"))
        .select(*_CHANNEL, "rule", value.alias("value"))
    )


def _ties(writes: DataFrame) -> list[str]:
    """What orders the writes of one step: their ``write`` number, where they carry one."""
    return ["write"] if "write" in writes.columns else []


def _rule(rules: dict[str, str]):
    out = F.lit("last")
    for channel, name in rules.items():
        out = F.when(F.col("channel") == channel, F.lit(name)).otherwise(out)
    return out


def _numbered(df: DataFrame, keys: list[str], order: str, chunk_rows: int) -> DataFrame:
    """Add ``position``, counting from 1 in order."""
    counted = Ordered(df, keys, order, chunk_rows, ties=_ties(df)).look_back(total={"before": F.lit(1)})
    return counted.df.select(*df.columns, (F.col("before") + 1).cast("long").alias("position"))


def reduce_appends(writes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Appended list of each channel, one row per element with its position.

    Several writes of one step need their number within the step as ``write``.
    """
    rows = writes.select(*_CHANNEL, "step", *_ties(writes), "value")
    return _numbered(rows, _CHANNEL, "step", chunk_rows).select(*_CHANNEL, "position", "value")


def reduce_unions(writes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distinct values of each channel in order of first write, one row each."""
    order = ["step", *_ties(writes)]
    first = writes.groupBy(*_CHANNEL, "value").agg(F.min(F.struct(*order)).alias("at"))
    first = materialize(first.select(*_CHANNEL, "value", *[f"at.{c}" for c in order]), "first-writes")
    return _numbered(first, _CHANNEL, "step", chunk_rows).select(*_CHANNEL, "position", "value")


def reduce_maps(writes: DataFrame) -> DataFrame:
    """Overlaid map of each channel: latest value per key; writes carry ``key``."""
    return writes.groupBy(*_CHANNEL, "key").agg(
        F.max_by("value", F.struct("step", *_ties(writes))).alias("value")
    )


def channel_versions(writes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each write with the version it gave its channel: the writes so far."""
    rows = writes.select(*_CHANNEL, "step", *_ties(writes))
    return _numbered(rows, _CHANNEL, "step", chunk_rows).withColumnRenamed("position", "version")


# --- checkpoints ---------------------------------------------------------------------------


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint of the highest step of each thread."""
    rest = [c for c in checkpoints.columns if c != "thread_id"]
    last = checkpoints.groupBy("thread_id").agg(F.max_by(F.struct(*rest), "step").alias("c"))
    return last.select("thread_id", "c.*").select(*checkpoints.columns)


def checkpoint_by_id(checkpoints: DataFrame, key: str) -> DataFrame:
    return checkpoints.filter(F.col("id") == key)


def checkpoint_history(checkpoints: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` per thread; the rank limit is applied before the shuffle too."""
    newest = Window.partitionBy("thread_id").orderBy(F.desc("step"))
    return (
        checkpoints.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= limit)
    )


def checkpoint_prune(checkpoints: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Checkpoints left when each thread keeps its newest, and how many go per thread."""
    left = checkpoint_history(checkpoints, keep).drop("age")
    removed = checkpoints.groupBy("thread_id").agg(
        F.greatest(F.count("*") - keep, F.lit(0)).alias("removed")
    )
    return left, removed


def delete_thread(checkpoints: DataFrame, thread_id) -> DataFrame:
    return checkpoints.filter(F.col("thread_id") != thread_id)
