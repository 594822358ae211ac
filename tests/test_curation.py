"""Rule-book allocation against a row-by-row scan."""

import random
import re

import pytest

from supportlake.operators import curation

BOOK = curation.rule_book([
    ("A", "AUTO_HANDLE", 3, r"\bred\b", r"\bblue\b", "r0"),
    ("A", "ESCALATE", 4, r"\b(?:red|green)\b", None, "r1"),
    ("B", "ESCALATE", 2, r"\bblue\b", None, "r2"),
    ("A", "AUTO_HANDLE", 4, r"gr.*n", r"\bred\b", "r3"),
    ("C", "AUTO_HANDLE", 5, r"nothing like this", None, "r4"),
    ("B", "AUTO_HANDLE", 9, r"\b(?:blue|green)\b", None, "r5"),
])
SCHEMA = "customer_tweet_id long, brand_tweet_id long, customer_text string, brand_text string, links array<string>"


def scan(rows, per_intent, without_urls=False):
    rows = sorted(r for r in ((b, c, t.strip()) for c, b, t, *_ in rows)
                  if len(r[2]) >= 25 and not (without_urls and re.search("https?://", r[2])))
    out, claimed = [], set()
    for rule in BOOK:
        found = [r for r in rows if r[1] not in claimed and re.search(rule.include, r[2], re.I)
                 and not (rule.exclude and re.search(rule.exclude, r[2], re.I))][:rule.limit]
        for b, c, _ in found:
            n = sum(x[0] == rule.intent for x in out)
            if n < per_intent:
                out.append((rule.intent, rule.action, f"eval_{rule.intent.lower()}_{n + 1:03d}", b, c))
                claimed.add(c)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_rules_in_order_quota_and_claims(spark, seed):
    rng = random.Random(seed)
    words = ["red", "blue", "Green", "grown", "https://x.y"]
    rows = [(rng.choice([1, 1, 1, 2, 3, rng.randrange(40)]), i,
             " " + " ".join(rng.choice(words) for _ in range(2)) + rng.choice([" padded to a fair length", ""]), "ok ", [])
            for i in rng.sample(range(1000), 120)]
    for urls in (False, True):
        got = curation.curated_set(spark.createDataFrame(rows, SCHEMA), BOOK, urls, per_intent=5).collect()
        key = sorted((r["true_intent"], r["true_action"], r["eval_id"], r["brand_tweet_id"], r["customer_tweet_id"]) for r in got)
        assert key == scan(rows, 5, urls)


def test_no_match_gives_no_rows_and_the_check_lists_every_intent(spark):
    golden = curation.curated_set(spark.createDataFrame([], SCHEMA), BOOK)
    intents = spark.createDataFrame([("A",), ("B",)], "name string")
    assert {(r["intent"], r["n"], r["ok"]) for r in curation.set_check(golden, intents).collect()} == {
        ("A", 0, False), ("B", 0, False), ("ALL", 0, False)}
