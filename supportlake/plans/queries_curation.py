"""Golden sets by rule book, and their check."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.operators import curation
from supportlake.plans import oracle as sq
from supportlake.plans.queries import _pairs_cte, written_corpus
from supportlake.plans.registry import query
from supportlake.taxonomy import taxonomy_df


def _rules_cte(rows: list[tuple], without_urls: bool) -> str:
    """One pair of tables per rule: what it finds (s), what the quota lets in (t)."""
    strip = f"regexp_replace(customer_text, {sq.lit('^' + tx.PY_WHITESPACE + '+|' + tx.PY_WHITESPACE + '+$')}, '', 'g')"
    url = f" AND NOT regexp_matches(message, {sq.lit(fixed.CURATION_URL_PATTERN)})" if without_urls else ""
    parts = [f"""{_pairs_cte()},
stripped AS (SELECT *, {strip} AS message FROM pairs),
pool AS MATERIALIZED (SELECT customer_tweet_id AS cid, brand_tweet_id AS bid, message, brand_text, links FROM stripped
  WHERE length(message) >= {fixed.CURATION_MIN_LENGTH}{url})"""]
    for i, (intent, action, limit, include, exclude, reason) in enumerate(rows):
        cond = f"regexp_matches(message, {sq.lit(include)}, 'i')"
        if exclude:
            cond += f" AND NOT regexp_matches(message, {sq.lit(exclude)}, 'i')"
        used = " UNION ALL ".join(f"SELECT cid FROM t{j}" for j in range(i))
        free = f" AND cid NOT IN ({used})" if used else ""
        had = " + ".join(["0"] + [f"(SELECT count(*) FROM t{j})" for j in range(i) if rows[j][0] == intent])
        parts.append(f"s{i} AS MATERIALIZED (SELECT * FROM pool WHERE {cond}{free} ORDER BY bid LIMIT {limit})")
        parts.append(f"""t{i} AS MATERIALIZED (SELECT * FROM (
  SELECT s{i}.*, {sq.lit(intent)} AS intent, {sq.lit(action)} AS action, {sq.lit(reason)} AS reason,
         {had} + row_number() OVER (ORDER BY bid) AS n FROM s{i}) WHERE n <= {fixed.GOLDEN_PER_INTENT})""")
    union = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(rows)))
    bstrip = strip.replace("customer_text", "brand_text")
    parts.append(f"""golden AS (
  SELECT 'eval_' || lower(substr(intent, 1, 3)) || '_' || lpad(CAST(n AS VARCHAR), 3, '0') AS eval_id,
         cid AS customer_tweet_id, bid AS brand_tweet_id, message AS customer_text, {bstrip} AS reference_reply,
         links AS reference_links, intent AS true_intent, action AS true_action, reason AS ground_truth_reason,
         {sq.lit(fixed.CURATION_ANNOTATOR)} AS annotator_id, {sq.lit(fixed.GOLDEN_STATUS)} AS annotation_status
  FROM ({union}))""")
    return ",\n".join(parts)


def _curated(spark, sf_dir, rows, without_urls):
    return curation.curated_set(written_corpus(spark, sf_dir), curation.rule_book(rows), without_urls)


@query("golden_rules_verified", lambda: f"WITH {_rules_cte(fixed.CURATION_RULES_VERIFIED, False)} SELECT * FROM golden")
def q_golden_rules_verified(spark, sf_dir):
    return _curated(spark, sf_dir, fixed.CURATION_RULES_VERIFIED, False)


@query("golden_rules_clean", lambda: f"WITH {_rules_cte(fixed.CURATION_RULES_CLEAN, True)} SELECT * FROM golden")
def q_golden_rules_clean(spark, sf_dir):
    return _curated(spark, sf_dir, fixed.CURATION_RULES_CLEAN, True)


@query("golden_rules_check", lambda: f"""WITH {_rules_cte(fixed.CURATION_RULES_CLEAN, True)},
c AS (SELECT i.intent, count(golden.true_intent) AS n
      FROM (SELECT unnest({sq.str_list(fixed.INTENTS)}) AS intent) i LEFT JOIN golden ON golden.true_intent = i.intent GROUP BY 1)
SELECT intent, n, n = {fixed.GOLDEN_PER_INTENT} AS ok FROM c
UNION ALL SELECT 'ALL', CAST(sum(n) AS BIGINT), sum(n) = count(*) * {fixed.GOLDEN_PER_INTENT} FROM c""")
def q_golden_rules_check(spark, sf_dir):
    golden = _curated(spark, sf_dir, fixed.CURATION_RULES_CLEAN, True)
    return curation.set_check(golden, taxonomy_df(spark)).select("intent", F.col("n").cast("long").alias("n"), "ok")
