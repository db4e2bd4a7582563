import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.operators import lifecycle as li
from feedloom.schemas import ARTICLE_STATUSES

COMMANDS = ["publish", "approve", "reject", "archive", "submit", "dance"]


def run_one(status, command):
    """Plain statement of the rules: (new status, error)."""
    need = {"publish": ("APPROVED", "PUBLISHED"), "approve": ("PENDING_REVIEW", "APPROVED"),
            "reject": ("PENDING_REVIEW", "REJECTED")}
    if command in need:
        required, result = need[command]
        if status == required:
            return result, None
        return status, f"Cannot {command} article in status {status}. Must be {required}."
    if command == "archive":
        return "ARCHIVED", "Article is already archived." if status == "ARCHIVED" else None
    if command == "submit":
        return "PENDING_REVIEW", None
    return status, f"Unknown command {command}"


def test_every_status_and_command(spark):
    rows = [(s, c) for s in ARTICLE_STATUSES for c in COMMANDS]
    df = spark.createDataFrame(rows, "status string, command string")
    out = df.select("status", "command", li.next_status(F.col("status"), F.col("command")).alias("n"),
                    li.refusal(F.col("status"), F.col("command")).alias("e")).collect()
    for r in out:
        assert (r.n, r.e) == run_one(r.status, r.command)


def test_step_and_apply(spark):
    articles = spark.createDataFrame([("a", "APPROVED", None), ("b", "RAW", None)], "id string, status string, published_at timestamp")
    commands = spark.createDataFrame([("a", "publish"), ("b", "approve"), ("x", "archive")], "article_id string, command string")
    now = F.lit(datetime(2026, 7, 16))
    outcomes = li.step(articles, commands, now)
    errors = {r.article_id: r.error for r in outcomes.collect()}
    assert errors == {"a": None, "b": "Cannot approve article in status RAW. Must be PENDING_REVIEW.",
                      "x": "Article with id 'x' not found"}
    after = {r.id: (r.status, r.published_at) for r in li.apply_outcomes(articles, outcomes, now).collect()}
    assert after == {"a": ("PUBLISHED", datetime(2026, 7, 16)), "b": ("RAW", None)}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    articles = [(f"a{i}", rng.choice(ARTICLE_STATUSES)) for i in range(6)]
    start = datetime(2026, 1, 1)
    log = []
    for seq in range(600):
        # One article gets a third of the log, much of it within the same seconds.
        name = "a0" if rng.random() < 0.34 else f"a{rng.randrange(8)}"
        at = start + timedelta(hours=rng.randrange(30), seconds=rng.randrange(3), microseconds=rng.randrange(4) * 1000)
        log.append((seq, name, rng.choice(COMMANDS), at))
    table = spark.createDataFrame([(*a, None) for a in articles], "id string, status string, published_at timestamp")
    commands = spark.createDataFrame(log, "seq long, article_id string, command string, ts timestamp")
    got = {r.seq: (r.status_before, r.status_after, r.error) for r in li.replay(table, commands).collect()}

    state, published, expected = dict(articles), {}, {}
    for seq, name, command, at in sorted(log, key=lambda c: (c[3], c[0])):
        if name not in state:
            expected[seq] = (None, None, f"Article with id '{name}' not found")
            continue
        after, error = run_one(state[name], command)
        expected[seq] = (state[name], after, error)
        if command == "publish" and error is None:
            published[name] = at
        state[name] = after
    assert got == expected
    for ranges in (1, 3, 200):
        cut = li.replay(table, commands, ranges)
        assert {r.seq: (r.status_before, r.status_after, r.error) for r in cut.collect()} == expected
    ends = {r.id: (r.status, r.published_at) for r in li.final_statuses(table, li.replay(table, commands)).collect()}
    assert ends == {n: (s, published.get(n)) for n, s in state.items()}


def test_commands_with_status(spark):
    articles = spark.createDataFrame([("a", "RAW")], "id string, status string")
    commands = spark.createDataFrame([(1, "a"), (2, "x")], "seq long, article_id string")
    assert sorted((r.seq, r.status) for r in li.commands_with_status(articles, commands).collect()) == [(1, "RAW"), (2, None)]


def test_commands_without_article_or_time_are_refused(spark):
    at = datetime(2026, 1, 1)
    table = spark.createDataFrame([("a", "APPROVED")], "id string, status string")
    rows = [(1, "a", "publish", at), (2, None, "publish", at), (3, "a", "archive", None)]
    out = li.replay(table, spark.createDataFrame(rows, "seq long, article_id string, command string, ts timestamp")).collect()
    assert {r.seq: (r.status_after, r.error) for r in out} == {
        1: ("PUBLISHED", None), 2: (None, "Command without an article"), 3: (None, "Command without a time")}


def test_replay_of_nothing(spark):
    table = spark.createDataFrame([("a", "APPROVED")], "id string, status string")
    log = spark.createDataFrame([], "seq long, article_id string, command string, ts timestamp")
    assert li.replay(table, log).count() == 0


def test_replay_of_a_million_commands_at_one_time(spark):
    n, at = 1_000_000, F.lit(datetime(2026, 1, 1)).cast("timestamp")
    table = spark.createDataFrame([("a", "RAW")], "id string, status string")
    # submit, approve, publish, archive, and again: each one follows from the one before.
    turn = F.element_at(F.array(*[F.lit(c) for c in ("submit", "approve", "publish", "archive")]), (F.col("id") % 4 + 1).cast("int"))
    commands = spark.range(n).select(F.col("id").alias("seq"), F.lit("a").alias("article_id"), turn.alias("command"), at.alias("ts"))
    out = li.replay(table, commands, ranges=16)
    before = F.element_at(F.array(*[F.lit(s) for s in ("ARCHIVED", "PENDING_REVIEW", "APPROVED", "PUBLISHED")]), (F.col("seq") % 4 + 1).cast("int"))
    wrong = out.filter(F.col("error").isNotNull() | (F.col("status_before") != F.when(F.col("seq") == 0, "RAW").otherwise(before)))
    assert out.count() == n and wrong.count() == 0
    sizes = [r["count"] for r in li.command_functions(commands, 16).groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < n // 8


def test_functions_of_commands_pack():
    from itertools import product

    maps = li._command_maps()
    assert li._unpack(maps[-1]) == list(range(len(ARTICLE_STATUSES) + 1))
    for code, status in product(range(len(li.COMMANDS)), range(len(ARTICLE_STATUSES))):
        assert ARTICLE_STATUSES[li._unpack(maps[code])[status]] == run_one(ARTICLE_STATUSES[status], li.COMMANDS[code])[0]
    assert li.BITS * (len(ARTICLE_STATUSES) + 1) < 64
