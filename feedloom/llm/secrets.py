"""Secret scans over an incremental ledger of content-addressed texts.

A text version is a blob, named by its SHA-256; a path (here: a document) points at the
blob of each of its versions. The ledger records which (blob, rule version) pairs have been
scanned, and what was found in them. A scan takes only the pairs that the ledger lacks, each
blob once however many paths share it, appends the outcome as a new batch, and joins the
findings back to all paths. Everything is built-in functions.

Positions come from the pieces between the matches: the pattern splits the text, and the
lengths of pieces and matches add up, in code points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import staged
from feedloom.sources.store import append_batch, read_batches

FINDING = T.StructType().add("start", "long").add("rank", "integer").add("end", "long").add("kind", "string")
LEDGER_SCHEMA = T.StructType().add("blob", "string").add("rule_version", "string").add("findings", T.ArrayType(FINDING))


class Rule(NamedTuple):
    """A match of ``pattern`` counts if its ``group`` has ``least`` characters or more.

    A text without any of ``hints`` in either case has no match, and is not searched.
    """

    kind: str
    pattern: str
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 1
    base: bool = False


# The patterns of the kinds of secrets.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", (), 0, 32, True),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}", ("aiza",)),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}", ("sk_live_",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
)
RULE_VERSION = "1"


def blob_id(text: Column) -> Column:
    """The content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def matches(text: Column, low: Column, rule: Rule, rank: int) -> Column:
    """Array of a rule's matches with the lengths of the piece before, the match and the group."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    wholes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    bodies = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    pairs = F.zip_with(pieces, wholes, lambda a, b: F.struct(a.alias("piece"), b.alias("match")))
    rows = F.zip_with(pairs, bodies, lambda x, body: F.struct(
        F.lit(rank).alias("rank"), x["piece"].alias("piece"), x["match"].alias("match"),
        F.coalesce(body >= rule.least, F.lit(False)).alias("counts"),
    ))
    none = F.expr("cast(array() as array<struct<rank: int, piece: int, match: int, counts: boolean>>)")
    possible = text.rlike(rule.pattern)
    if rule.hints:
        possible = reduce(or_, [low.contains(hint) for hint in rule.hints]) & possible
    return F.when(possible, F.filter(rows, lambda x: x["match"].isNotNull())).otherwise(none)


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of each of ``blobs`` (blob, text) that has any, by start and rank of the rule.

    A blob that is given twice is reported once.
    """
    held = blobs.select("blob", "text", F.lower("text").alias("low"))
    found = F.concat(*[matches(F.col("text"), F.col("low"), rule, rank) for rank, rule in enumerate(rules)])
    some = held.select("blob", found.alias("found")).filter(F.exists("found", lambda m: m["counts"]))
    each = some.dropDuplicates(["blob"]).select("blob", F.posexplode("found").alias("pos", "m")).select("blob", "pos", "m.*")
    up_to = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("piece") + F.col("match")).over(up_to)).filter("counts")
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    finding = F.struct((F.col("end") - F.col("match")).alias("start"), "rank", "end", kinds[F.col("rank")].alias("kind"))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(finding)).alias("findings"))


def scan_versions(
    versions: DataFrame, ledger: str, batch: int = 0,
    rules: Sequence[Rule] = RULES, rule_version: str = RULE_VERSION,
) -> DataFrame:
    """Scan what the ledger's earlier batches lack of ``versions`` (doc_id, text), write it as
    ``batch``, and return (doc_id, blob, findings) for every row of ``versions``.

    Writing the same batch again replaces it. Null and empty texts are the empty blob, which
    has no findings; equal texts share one scan; repeated rows, and rows with a null id,
    come back once each. Other columns of ``versions`` are left out. Findings are null where
    there are none. An empty table writes an empty batch and gives an empty result.
    """
    spark = versions.sparkSession
    of_version = F.col("rule_version") == rule_version
    paths = staged(versions.select("doc_id", blob_id(F.col("text")).alias("blob")), "paths")
    seen = read_batches(spark, ledger, LEDGER_SCHEMA, before=batch).filter(of_version).select("blob")
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left_anti")

    # One row for each unseen blob (or equal rows) brings its text.
    wanted = unseen.select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_doc_id"))
    here = (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    held = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), blob_id(F.col("text")).alias("blob"))
    hits = scan(held.join(wanted, here, "left_semi"), rules)
    outcome = unseen.select("blob").join(hits, "blob", "left")
    append_batch(outcome.select("blob", F.lit(rule_version).alias("rule_version"), "findings"), ledger, batch)

    known = read_batches(spark, ledger, LEDGER_SCHEMA).filter(of_version & F.col("findings").isNotNull())
    return paths.join(known.select("blob", "findings"), "blob", "left")


def digest(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds and span lists of each row of ``scan_versions``."""
    base = [rule.kind for rule in rules if rule.base]

    def listed(findings: Column) -> Column:
        spans = F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
        return F.coalesce(F.array_join(spans, ","), F.lit(""))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("findings", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")

    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(listed(F.filter("findings", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )
