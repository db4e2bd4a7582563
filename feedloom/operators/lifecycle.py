"""Guarded status transitions, one round or a whole ordered command log.

A log replay must run one article's commands in order, yet one article may own a large
part of the log, also within one instant. A run of commands is a function from status to
status, and such functions compose, so the replay is a prefix scan:

1. The log is dealt to ranges of (article, time, number) and sorted there. Each command gets
   the function of the commands before it on its article in its range.
2. A range's last function per article is all that other ranges need: these run in order of
   the ranges, from the stored status, and give each (range, article) its start status.
3. A command's status is its function's value at that start.

Every pass streams. Nothing is gathered per article or time slice, and a pair (range,
article) is never larger than a range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.joins import batch_join, probe_join
from feedloom.schemas import ARTICLE_STATUSES
from feedloom.sources.store import run_dir, stage

# Guarded commands (name, required status, resulting status) and free ones.
FREE = (("archive", "ARCHIVED"), ("submit", "PENDING_REVIEW"))
GUARDED = (
    ("publish", "APPROVED", "PUBLISHED"),
    ("approve", "PENDING_REVIEW", "APPROVED"),
    ("reject", "PENDING_REVIEW", "REJECTED"),
)
ALREADY_ARCHIVED = "Article is already archived."
COMMANDS = tuple(name for name, *_ in (*FREE, *GUARDED))
MISSING = len(ARTICLE_STATUSES)
#: Bits of a status in a packed function; all of them fit 63 bits.
BITS = 4


def next_status(status: Column, command: Column) -> Column:
    """Status after the command; a refused or unknown command changes nothing.

    ``submit`` stands for the free status set to PENDING_REVIEW, which has no guard.
    """
    out = status
    for name, result in FREE:
        out = F.when(command == name, result).otherwise(out)
    for name, required, result in GUARDED:
        out = F.when((command == name) & (status == required), result).otherwise(out)
    return out


def refusal(status: Column, command: Column) -> Column:
    """Why the command is refused in this status; null when it is carried out."""
    out = F.when((command == "archive") & (status == "ARCHIVED"), F.lit(ALREADY_ARCHIVED))
    for name, required, _ in GUARDED:
        text = F.concat(F.lit(f"Cannot {name} article in status "), status, F.lit(f". Must be {required}."))
        out = out.when((command == name) & (status != required), text)
    return out.when(~command.isin(*COMMANDS), F.concat(F.lit("Unknown command "), command))


def step(articles: DataFrame, commands: DataFrame, as_of: Column) -> DataFrame:
    """One command per article against the current table: outcome rows.

    ``commands(article_id, command)`` holds each article once; unknown ids give NOT_FOUND.
    """
    current = articles.select(F.col("id").alias("article_id"), "status", "published_at")
    joined = probe_join(commands, current, "article_id", F.col("article_id"))
    joined = joined.select(*commands.columns, "hit.status", "hit.published_at")
    status, command = F.col("status"), F.col("command")
    found = status.isNotNull()
    error = F.when(~found, F.format_string("Article with id '%s' not found", "article_id"))
    error = error.otherwise(refusal(status, command))
    published = F.when((command == "publish") & (status == "APPROVED"), as_of).otherwise(F.col("published_at"))
    return joined.select(
        *commands.columns,
        "status",
        F.when(found, next_status(status, command)).alias("new_status"),
        published.alias("published_at"),
        error.alias("error"),
    )


def latest_command(commands: DataFrame) -> DataFrame:
    """The last command per article; earlier ones are reduced before the shuffle."""
    last = F.max_by(F.struct("seq", "command", "ts"), F.struct("ts", "seq"))
    return commands.groupBy("article_id").agg(last.alias("_c")).select("article_id", "_c.*")


def apply_outcomes(articles: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """New article table after one round of outcomes (one row per article)."""
    done = outcomes.filter(F.col("error").isNull()).select(
        F.col("article_id").alias("id"),
        F.struct("new_status", "published_at").alias("_o"),
    )
    joined = batch_join(articles, done, "id")
    hit = F.col("_o").isNotNull()
    new = {
        "status": F.when(hit, F.col("_o.new_status")).otherwise(F.col("status")),
        "published_at": F.when(hit, F.col("_o.published_at")).otherwise(F.col("published_at")),
    }
    if "updated_at" in articles.columns:
        new["updated_at"] = F.when(hit, as_of).otherwise(F.col("updated_at"))
    return joined.withColumns(new).select(*articles.columns)


def _status_index(status: Column) -> Column:
    """Position in the closed status set; MISSING for an article that does not exist."""
    position = F.array_position(F.array(*[F.lit(s) for s in ARTICLE_STATUSES]), status).cast("int") - 1
    return F.coalesce(position, F.lit(MISSING))


def _status_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in ARTICLE_STATUSES]), index)


def _pack(results: Sequence[int]) -> int:
    """A function as one number: four bits for the result of each start status."""
    return sum(result << BITS * i for i, result in enumerate(results))


def _unpack(packed: int) -> list[int]:
    return [packed >> BITS * i & (1 << BITS) - 1 for i in range(MISSING + 1)]


def _value(packed: str, start: str) -> Column:
    return F.expr(f"cast(shiftright({packed}, {BITS} * {start}) & {(1 << BITS) - 1} as int)")


def _command_maps() -> list[int]:
    """Every command as a function. The last one changes nothing and stands for the others."""
    index = {status: i for i, status in enumerate(ARTICLE_STATUSES)}
    rows = [[index[result]] * MISSING for _, result in FREE]
    for _, required, result in GUARDED:
        rows.append([index[result] if s == required else index[s] for s in ARTICLE_STATUSES])
    return [_pack([*row, MISSING]) for row in (*rows, range(MISSING))]


def _command_index(command: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(c) for c in COMMANDS]), command).cast("int")
    return F.coalesce(F.when(position > 0, position - 1), F.lit(len(COMMANDS)))


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the functions of an article's earlier commands in this range, without and with each."""
    part, place, article = TaskContext.get().partitionId(), 0, object()
    maps = _command_maps()
    identity, seen = maps[-1], {}
    after = identity
    for batch in batches:
        before_all, after_all = [], []
        for this, code in zip(batch.column("article_id").to_pylist(), batch.column("code").to_pylist(), strict=True):
            before = after if this == article else identity
            after = seen.get((before, code))
            if after is None:  # there are only few such functions
                step_of = _unpack(maps[code])
                after = seen[before, code] = _pack([step_of[status] for status in _unpack(before)])
            article = this
            before_all.append(before)
            after_all.append(after)
        added = {
            "part": pa.array([part] * batch.num_rows, pa.int32()),
            "place": pa.array(range(place, place + batch.num_rows), pa.int64()),
            "before": pa.array(before_all, pa.int64()), "after": pa.array(after_all, pa.int64()),
        }
        place += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


def _range_starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start status of every range of an article, the ranges in order."""
    article, status = object(), MISSING
    for batch in batches:
        starts = []
        columns = [batch.column(name).to_pylist() for name in ("article_id", "stored", "after")]
        for this, stored, after in zip(*columns, strict=True):
            status = status if this == article else stored
            article = this
            starts.append(status)
            status = after >> BITS * status & (1 << BITS) - 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("article_id"), batch.column("part"), pa.array(starts, pa.int32())], ["article_id", "part", "start"]
        )


def command_functions(commands: DataFrame, ranges: int | None = None) -> DataFrame:
    """``commands`` with their range ``part``, their ``place`` in it, and the functions
    ``before`` and ``after`` them. Commands without article or time change nothing."""
    keyed = F.col("article_id").isNotNull() & F.col("ts").isNotNull()
    code = F.when(keyed, _command_index(F.col("command"))).otherwise(len(COMMANDS)).cast("int")
    coded = commands.select("seq", "article_id", "command", "ts", code.alias("code"))
    order = ["article_id", "ts", "seq", "command"]
    dealt = coded.repartitionByRange(ranges, *order) if ranges else coded.repartitionByRange(*order)
    schema = T.StructType([
        *coded.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()),
        T.StructField("before", T.LongType()), T.StructField("after", T.LongType()),
    ])
    return dealt.sortWithinPartitions(*order).mapInArrow(_prefixes, schema)


def replay(articles: DataFrame, commands: DataFrame, ranges: int | None = None) -> DataFrame:
    """Run the whole log ``commands(seq, article_id, command, ts)`` in ``(ts, seq)`` order.

    One row per command with ``status_before``, ``status_after`` and ``error``; commands
    on unknown articles come out with null statuses and a not-found error. Commands without
    article or time change nothing and come out with an error. The log is read by one job,
    which writes its commands and functions below the shared folder.
    """
    done = stage(command_functions(commands, ranges), run_dir(commands.sparkSession, "replay"))
    ends = done.filter(F.col("article_id").isNotNull()).groupBy("article_id", "part").agg(F.max_by("after", "place").alias("after"))
    base = articles.select(F.col("id").alias("article_id"), _status_index(F.col("status")).alias("stored"))
    ends = ends.join(base, "article_id", "left").withColumn("stored", F.coalesce("stored", F.lit(MISSING)).cast("int"))
    in_order = ends.select("article_id", "part", "stored", "after").repartition("article_id").sortWithinPartitions("article_id", "part")
    schema = T.StructType([done.schema["article_id"], done.schema["part"], T.StructField("start", T.IntegerType())])
    rows = done.join(in_order.mapInArrow(_range_starts, schema), ["article_id", "part"], "left")

    named = rows.withColumn("status_before", F.when(F.col("ts").isNotNull(), _status_name(_value("before", "start"))))
    status, command = F.col("status_before"), F.col("command")
    missing = F.format_string("Article with id '%s' not found", "article_id")
    return named.select(
        "seq",
        "article_id",
        "command",
        "ts",
        "status_before",
        F.when(status.isNotNull(), next_status(status, command)).alias("status_after"),
        F.when(F.col("article_id").isNull(), "Command without an article")
        .when(F.col("ts").isNull(), "Command without a time")
        .when(status.isNull(), missing).otherwise(refusal(status, command)).alias("error"),
    )


def final_statuses(articles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Article table with the status and publication time after a replay."""
    carried = outcomes.filter(F.col("status_before").isNotNull())
    last = F.max_by(F.col("status_after"), F.struct("ts", "seq")).alias("_status")
    done = (F.col("command") == "publish") & F.col("error").isNull()
    published = F.max(F.when(done, F.col("ts"))).alias("_published")
    ends = carried.groupBy(F.col("article_id").alias("id")).agg(last, published)
    joined = articles.join(ends, "id", "left")
    return joined.withColumns({
        "status": F.coalesce("_status", "status"),
        "published_at": F.coalesce("_published", "published_at"),
    }).select(*articles.columns)


def commands_with_status(articles: DataFrame, commands: DataFrame) -> DataFrame:
    """Each command with the stored status of its article, however hot the article is."""
    table = articles.select(F.col("id").alias("article_id"), "status")
    joined = probe_join(commands, table, "article_id", F.col("seq"))
    return joined.select(*commands.columns, F.col("hit.status").alias("status"))
