"""Golden set curated by an ordered rule book.

Each rule takes, in corpus order, its first ``limit`` matching rows whose
customer message no earlier rule has claimed; an intent stops at its quota and
a row refused by the quota is not claimed.

Every rule is a flag of one pass over the pairs.  Earlier rules claim at most
quota x intents messages, so a rule can only take rows of its first
``limit`` + quota x intents messages, and at most ``limit`` rows of each: two
partial top-k windows cut the matches to that, whatever the corpus's size.
The rules are then folded in order over this bounded table (a few thousand
ids), without texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.operators.golden import ORDER_KEY, golden_check, seq_id


class Rule(NamedTuple):
    intent: str
    action: str
    limit: int
    include: str
    exclude: str | None
    reason: str


def rule_book(rows: Sequence[tuple]) -> list[Rule]:
    return [Rule(*r) for r in rows]


def matches(text: Column | str, rule: Rule) -> Column:
    """Include pattern found and exclude pattern (if any) not found, any case."""
    col = F.col(text) if isinstance(text, str) else text
    hit = col.rlike("(?i)" + tx.py_regex(rule.include))
    return hit & ~col.rlike("(?i)" + tx.py_regex(rule.exclude)) if rule.exclude else hit


def curation_pool(pairs: DataFrame, without_urls: bool = False, min_length: int = fixed.CURATION_MIN_LENGTH) -> DataFrame:
    """Pairs with a long enough message, without links if asked for."""
    pool = pairs.withColumn("customer_text", tx.py_strip("customer_text")).where(F.length("customer_text") >= min_length)
    return pool.where(~F.col("customer_text").rlike(fixed.CURATION_URL_PATTERN)) if without_urls else pool


def candidates(pool: DataFrame, rules: Sequence[Rule], claims: int) -> DataFrame:
    """One row (rows: array of (k, customer_tweet_id) in corpus order) per rule
    that matches something; ``claims`` bounds the messages other rules take."""
    widest = max(r.limit for r in rules)
    hit = F.array_compact(F.array(*[F.when(matches("customer_text", r), F.lit(i)) for i, r in enumerate(rules)]))
    hits = pool.select(F.col(ORDER_KEY).alias("k"), "customer_tweet_id", F.explode(hit).alias("rule"))
    of_message = Window.partitionBy("rule", "customer_tweet_id").orderBy("k")
    kept = hits.withColumn("_n", F.row_number().over(of_message)).where(F.col("_n") <= widest)
    messages = kept.groupBy("rule", "customer_tweet_id").agg(
        F.min("k").alias("first"), F.collect_list(F.struct("k", "customer_tweet_id")).alias("rows"))
    in_order = Window.partitionBy("rule").orderBy("first")
    firsts = messages.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= widest + claims)
    return firsts.groupBy("rule").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))


def allocate(cands: DataFrame, rules: Sequence[Rule], per_intent: int) -> DataFrame:
    """(rule, n, k, customer_tweet_id): the rules folded in order; ``n`` counts
    within the intent from 1."""
    book = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.intent).alias("intent"), F.lit(r.limit).alias("limit"))
                     for i, r in enumerate(rules)])
    none = F.expr("CAST(array() AS ARRAY<STRUCT<rule: INT, intent: STRING, n: INT, k: BIGINT, customer_tweet_id: BIGINT>>)")

    def step(taken: Column, rule: Column) -> Column:
        claimed = F.transform(taken, lambda t: t["customer_tweet_id"])
        rows = F.coalesce(F.element_at("by_rule", rule["rule"]),
                          F.expr("CAST(array() AS ARRAY<STRUCT<k: BIGINT, customer_tweet_id: BIGINT>>)"))
        free = F.filter(rows, lambda r: ~F.array_contains(claimed, r["customer_tweet_id"]))
        had = F.size(F.filter(taken, lambda t: t["intent"] == rule["intent"]))
        new = F.slice(free, F.lit(1), F.least(rule["limit"], F.greatest(F.lit(per_intent) - had, F.lit(0))))
        return F.concat(taken, F.transform(new, lambda r, i: F.struct(
            rule["rule"].alias("rule"), rule["intent"].alias("intent"), (had + i + 1).alias("n"),
            r["k"].alias("k"), r["customer_tweet_id"].alias("customer_tweet_id"))))

    book_rows = cands.select("rule", F.transform("rows", lambda r: F.struct(
        r["k"].cast("long").alias("k"), r["customer_tweet_id"].cast("long").alias("customer_tweet_id"))).alias("rows"))
    # one row: at most rules x (limit + claims) x limit pairs of ids
    one = book_rows.agg(F.map_from_entries(F.collect_list(F.struct("rule", "rows"))).alias("by_rule"))
    taken = one.select(F.explode(F.aggregate(book, none, step)).alias("t"))
    return taken.select("t.rule", "t.n", "t.k", "t.customer_tweet_id")


def curated_set(pairs: DataFrame, rules: Sequence[Rule], without_urls: bool = False,
                per_intent: int = fixed.GOLDEN_PER_INTENT) -> DataFrame:
    """The golden set of a rule book, with the columns of ``golden.golden_set``.

    ``pairs`` is read twice (flags, then the texts of the chosen rows), so pass
    a written table.  Its reply ids are its key.  No match gives no rows."""
    pool = curation_pool(pairs, without_urls)
    claims = per_intent * len({r.intent for r in rules})
    taken = allocate(candidates(pool, rules, claims), rules, per_intent)

    def of_rule(field: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("rule"))

    # at most per_intent x intents rows
    chosen = F.broadcast(taken.select("rule", "n", "k"))
    out = pool.join(chosen, pool[ORDER_KEY] == chosen["k"])
    return out.select(
        seq_id(F.concat(F.lit("eval_"), F.lower(F.substring(of_rule("intent"), 1, 3)), F.lit("_")), F.col("n")).alias("eval_id"),
        "customer_tweet_id", ORDER_KEY, "customer_text",
        tx.py_strip("brand_text").alias("reference_reply"),
        tx.links_to_string("links").alias("reference_links"),
        of_rule("intent").alias("true_intent"),
        of_rule("action").alias("true_action"),
        of_rule("reason").alias("ground_truth_reason"),
        F.lit(fixed.CURATION_ANNOTATOR).alias("annotator_id"),
        F.lit(fixed.GOLDEN_STATUS).alias("annotation_status"),
    )


def set_check(golden: DataFrame, intents: DataFrame, per_intent: int = fixed.GOLDEN_PER_INTENT) -> DataFrame:
    """``golden_check`` with a last row for the whole set (intent ``ALL``)."""
    checks = golden_check(golden, intents, per_intent)
    total = checks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("intents"))
    return checks.unionByName(total.select(
        F.lit("ALL").alias("intent"), "n", (F.col("n") == F.col("intents") * per_intent).alias("ok")))
