"""Streaming jobs as registered queries: each runs its stream to completion
(availableNow) and returns the sink contents.  Oracles are the batch SQL of
the same result for the windows/sessions the watermark has closed."""

from __future__ import annotations

from supportlake import fixed
from supportlake.plans import oracle as sq
from supportlake.plans.queries import _pairs_cte
from supportlake.plans.queries_pipeline import _decision_cte, evidence_reply_sql
from supportlake.plans.registry import query
from supportlake.sources.tables import tweet_view_sql
from supportlake.streaming import jobs


def _actions_cte() -> str:
    act, _ = sq.gt_action("weak_intent", "message")
    return f"""WITH tweets AS {tweet_view_sql()},
m AS (SELECT event_time, {sq.clean('text', False)} AS message FROM tweets WHERE inbound),
s AS (SELECT *, {sq.score_list('message')} AS _sc FROM m),
l AS (SELECT event_time, message,
        CASE WHEN list_max(_sc) >= {fixed.MIN_LABEL_SCORE} THEN {sq.best_intent('_sc')} END AS weak_intent FROM s),
a AS (SELECT event_time, coalesce(weak_intent, 'UNLABELLED') AS intent, {act} AS action FROM l),
wm AS (SELECT max(event_time) - INTERVAL 10 MINUTE AS wm FROM m)"""


def _windows_sql() -> str:
    return f"""{_actions_cte()},
g AS (SELECT date_trunc('hour', event_time) AS ws, intent, count(*) AS n_messages,
             count(*) FILTER (WHERE action = 'ESCALATE') AS n_escalations FROM a GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, intent, n_messages, n_escalations
FROM g WHERE ws + INTERVAL 1 HOUR <= (SELECT wm FROM wm)"""


@query("stream_windows", _windows_sql)
def q_stream_windows(spark, sf_dir):
    return jobs.escalation_windows(spark, sf_dir)


def _sliding_sql() -> str:
    return f"""{_actions_cte()},
e AS (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, event_time) - i * INTERVAL 15 MINUTE FOR i IN range(4)]) AS ws FROM a),
g AS (SELECT ws, intent, count(*) AS n_messages, count(*) FILTER (WHERE action = 'ESCALATE') AS n_escalations FROM e GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
       intent, n_messages, n_escalations, round(n_escalations / n_messages, 4) AS escalation_rate
FROM g WHERE ws + INTERVAL 1 HOUR <= (SELECT wm FROM wm)"""


@query("stream_sliding", _sliding_sql)
def q_stream_sliding(spark, sf_dir):
    return jobs.sliding_windows(spark, sf_dir)


def _sessions_sql() -> str:
    return f"""WITH tweets AS {tweet_view_sql()},
s0 AS (SELECT author_id, event_time,
         CASE WHEN lag(event_time) OVER (PARTITION BY author_id ORDER BY event_time, tweet_id) IS NULL
                OR event_time - lag(event_time) OVER (PARTITION BY author_id ORDER BY event_time, tweet_id)
                   >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s FROM tweets),
s1 AS (SELECT *, sum(new_s) OVER (PARTITION BY author_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS sid FROM s0),
g AS (SELECT author_id, min(event_time) AS st, max(event_time) + INTERVAL 30 MINUTE AS en, count(*) AS n_tweets
      FROM s1 GROUP BY author_id, sid)
SELECT author_id, strftime(st, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(en, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       n_tweets FROM g WHERE en <= (SELECT max(event_time) - INTERVAL 10 MINUTE FROM tweets)"""


@query("stream_sessions", _sessions_sql)
def q_stream_sessions(spark, sf_dir):
    return jobs.customer_sessions(spark, sf_dir)


@query("stream_dedup", lambda: f"WITH tweets AS {tweet_view_sql()} SELECT tweet_id, author_id, inbound FROM tweets")
def q_stream_dedup(spark, sf_dir):
    return jobs.dedup_messages(spark, sf_dir, redelivered="1 MINUTE")


@query("stream_pairs", lambda: f"""WITH tweets AS {tweet_view_sql()}
SELECT c.tweet_id AS customer_tweet_id, r.tweet_id AS brand_tweet_id, r.author_id AS brand
FROM tweets r JOIN tweets c ON r.in_response_to_tweet_id = c.tweet_id
WHERE NOT r.inbound AND c.inbound AND r.event_time >= c.event_time AND r.event_time <= c.event_time + INTERVAL 24 HOUR""")
def q_stream_pairs(spark, sf_dir):
    return jobs.reply_pairs(spark, sf_dir)


def _triage_sql() -> str:
    cleaned = sq.clean("text", False)
    base = f"""{_pairs_cte()},
msgs AS (SELECT tweet_id AS brand_tweet_id, CASE WHEN {cleaned} = '' THEN coalesce(text, '') ELSE {cleaned} END AS customer_text
         FROM tweets WHERE inbound)"""
    return f"""WITH {_decision_cte(base, "msgs", "pairs", "q.id <> d.customer_tweet_id")}, {evidence_reply_sql()}
SELECT id, intent, confidence, action, reason, reply, CAST(n_evidence AS INTEGER) AS n_evidence FROM answered"""


@query("stream_triage", _triage_sql)
def q_stream_triage(spark, sf_dir):
    return jobs.triage_stream(spark, sf_dir)
