"""URL filters: prefix rules first, link-graph propagation for the rest.

The host graph has an edge from a page's host to the host of every absolute
link in its HTML, and between a host and its parent domain (``m.a.org`` and
``a.org``), both ways, so that sub-domains share standing.  Personalised
PageRank runs forward from trusted seeds (hosts of pages that a rule allows)
and, on the reversed edges, from blocked seeds (hosts of pages that a rule
blocks): a host is distrusted for pointing at blocked hosts.  A host whose
distrust exceeds ``threshold`` times its trust is blocked.  The walk goes on
until no score changes by more than TOLERANCE of itself, so it has reached every
host that a seed can reach; a chain of n hosts takes n steps.

Everything is DataFrame functions; the graph holds hosts, not pages, and is
written to the shared checkpoint folder every few steps.  Pages meet what is
known of their host in joins where the pages of hot hosts (pages without a
host among them) are dealt to several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.session import cut_lineage

#: (host, path, verdict)
Rule = tuple[str, str, str]

DAMPING = 0.85
TOLERANCE = 1e-6     # largest change of a score, as a share of it, over the last CUT_EVERY steps
CUT_EVERY = 2
THRESHOLD = 1.0
DIGITS = 9           # scores are given with so many decimals; they are compared as they are
TIE = 1e-9           # scores closer than this share of themselves are equal
HOT = 1024           # a host with more than 1 / HOT of the pages is hot, so there are fewer than HOT such hosts
SALTS = 256          # parts that the pages of a hot host are dealt to

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; null or no ``://``: empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_frame(spark, rules: list[Rule]) -> DataFrame:
    """(host, path, verdict), hosts lower-cased."""
    empty = spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    if not rules:
        return empty
    rows = F.array(*[F.struct(F.translate(F.lit(h), _UPPER, _LOWER).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                     for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def hot_hosts(hosts: DataFrame) -> DataFrame:
    """(host) of ``hosts`` (host, n) with more than 1 / HOT of all pages."""
    total = hosts.agg(F.sum("n")).first()[0] or 0
    return cut_lineage(hosts.where(F.col("n") * HOT > total).select("host"))


def meet_hosts(pages: DataFrame, facts: DataFrame, hot: DataFrame) -> DataFrame:
    """``pages`` left join ``facts`` on host; pages of a hot host are dealt to
    SALTS parts, for which its one row of facts is copied."""
    known = F.broadcast(hot.select("host", F.lit(True).alias("__hot")))     # fewer than HOT rows
    part = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    salted = pages.join(known, "host", "left").withColumn("__salt", F.when(F.col("__hot"), part).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = facts.join(known, "host", "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return salted.join(copies, ["host", "__salt"], "left").drop("__salt")


def match_rules(pages: DataFrame, hosts: DataFrame, hot: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for pages of (page_id, host, path);
    the longest fitting rule wins (same length: the lesser text).  Rules meet
    distinct hosts, not pages; the rules of one host are as many as its parent
    domains have, and pages carry them by one join on host."""
    text = F.concat(F.col("host"), F.col("path"))
    grouped = rules.groupBy(F.col("host").alias("domain")).agg(F.collect_set(F.struct(
        (-F.length(text)).alias("order"), text.alias("rule"), "path", "verdict")).alias("rules"))
    fits = (hosts.where("host <> ''")
            .select("host", F.explode(domains_of(F.col("host"))).alias("domain"))
            .join(grouped, "domain").select("host", F.explode("rules").alias("r"))
            .groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("__rules")))
    best = F.get(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return (meet_hosts(pages, fits, hot)
            .select("page_id", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links of the HTML by host, and each host's link
    with its parent domains.  ``pages``: (host, html), ``hosts``: their (host)."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']?(https?://[^\"'\s>]+)"), F.lit(1))
    out = (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("to"))
           .select("src", host_of(F.col("to")).alias("dst")).where("dst <> '' and dst <> src")
           .groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")))
    chains = hosts.where("host <> ''").select(domains_of(F.col("host")).alias("d"))
    # the last label alone (com, org) says nothing about a host
    up = (chains.select(F.explode(F.filter(F.transform(
        F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.struct(
            F.get("d", i).alias("src"), F.get("d", i + 1).alias("dst"))),
        lambda x: x["dst"].contains(".") & (x["src"] != ""))).alias("x")).select("x.src", "x.dst").distinct())
    tied = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1.0))
    return out.unionByName(tied).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust).  ``seeds``: (side, host, weight), side 0 trusted,
    side 1 blocked.  Both sides run in one join per step; a hot destination is
    summed before the shuffle.  A seed set's weights are scaled to one.

    Without ``steps`` the walk goes on until scores settle.  It then starts from
    what the seeds get in any case, so scores only grow and a host is never
    taken for settled before the walk has reached it."""
    total = seeds.groupBy("side").agg(F.sum("weight").alias("total"))
    start = cut_lineage(seeds.join(total, "side").select("side", "host", (F.col("weight") / F.col("total")).alias("seed")))
    forth = edges.select(F.lit(0).alias("side"), "src", "dst", "n")
    back = edges.select(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = forth.unionByName(back)
    outs = both.groupBy("side", "src").agg(F.sum("n").alias("all"))
    flow = cut_lineage(both.join(outs, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    share = 1 - damping if steps is None else 1.0
    rank = start.select("side", "host", (F.lit(share) * F.col("seed")).alias("score"))
    fresh = start.select("side", "host", (F.lit(1 - damping) * F.col("seed")).alias("score"), F.lit(0.0).alias("last"))
    done = 0
    while steps is None or done < steps:
        before = rank.select("side", "host", F.lit(0.0).alias("score"), F.col("score").alias("last"))
        for _ in range(CUT_EVERY if steps is None else min(CUT_EVERY, steps - done)):
            moved = rank.withColumnRenamed("host", "src").join(flow, ["side", "src"]).select(
                "side", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("score"),
                F.lit(0.0).alias("last"))
            done, parts = done + 1, moved.unionByName(fresh)
            if done % CUT_EVERY == 0:
                parts = parts.unionByName(before)
            rank = parts.groupBy("side", "host").agg(F.sum("score").alias("score"), F.max("last").alias("last"))
        rank = cut_lineage(rank)
        if steps is None and not rank.where(F.col("score") > F.col("last") * (1 + TOLERANCE)).head(1):
            break
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("score"))), F.lit(0.0))
    return rank.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[Rule], steps: int | None = None, damping: float = DAMPING,
               threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of
    ``pages`` (page_id, url, html).  ``steps`` bounds the walk; without it scores
    settle first.

    Defined cases: a null url, or one without ``://``, has an empty host and
    path, fits no rule and is allowed; a null html has no links; a null page_id
    and repeated rows come back as they are; a host that no seed reaches is
    allowed (trust and distrust zero); equal scores allow; without rules
    everything is allowed; an empty table gives an empty one; other columns are
    not looked at."""
    spark = pages.sparkSession
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       F.col("html").cast("string").alias("html"))
    hosts = cut_lineage(own.groupBy("host").agg(F.count("*").alias("n")))
    hot = hot_hosts(hosts)
    judged = cut_lineage(match_rules(own.select("page_id", "host", "path"), hosts, hot, rule_frame(spark, rules)))
    edges = cut_lineage(host_edges(own.select("host", "html"), hosts))
    seeds = (judged.where("rule is not null").groupBy(
        F.when(F.col("verdict") == "block", 1).otherwise(0).alias("side"), "host").agg(F.count("*").cast("double").alias("weight")))
    scores = propagate(edges, seeds, steps, damping)
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust > F.lit(threshold * (1 + TIE)) * trust, "block").otherwise("allow")
    return meet_hosts(judged, scores, hot).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"),
        F.round(trust, DIGITS).alias("trust"), F.round(distrust, DIGITS).alias("distrust"))


def oracle_sql(rules: list[Rule], damping: float = DAMPING, threshold: float = THRESHOLD, digits: int = DIGITS) -> str:
    """The same verdicts as one DuckDB statement over ``pages``: the same walk,
    as a recursive query that goes on until no score of a step grew by more
    than TOLERANCE over the last CUT_EVERY (two) steps."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES {values}),
p AS (SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
fit AS (SELECT n, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
    FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
judged AS (SELECT p.*, rule, rverdict FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host <> ''),
chain AS (SELECT l, unnest(range(1, len(l))) AS i FROM hosts),
up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM chain),
tie AS (SELECT * FROM up WHERE contains(dst, '.') AND src <> ''),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\b(?:href|src)\\s*=\\s*["'']?(https?://[^"''\\s>]+)', 1)) AS u FROM p WHERE host <> ''),
linked AS (SELECT src, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst FROM found),
edges AS (SELECT src, dst, sum(n) AS n FROM (
    SELECT src, dst, count(*)::DOUBLE AS n FROM linked WHERE dst <> '' AND dst <> src GROUP BY src, dst
    UNION ALL SELECT src, dst, 1.0::DOUBLE FROM tie UNION ALL SELECT dst, src, 1.0::DOUBLE FROM tie) GROUP BY src, dst),
seeds AS (SELECT CASE WHEN rverdict = 'block' THEN 1 ELSE 0 END AS side, host, count(*)::DOUBLE AS w FROM judged WHERE rule IS NOT NULL GROUP BY ALL),
start AS (SELECT side, host, w / sum(w) OVER (PARTITION BY side) AS seed FROM seeds),
two AS (SELECT 0 AS side, src, dst, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges),
flow AS (SELECT side, src, dst, n / sum(n) OVER (PARTITION BY side, src) AS share FROM two),
walk(n, side, host, score, one, two, done) AS (
  SELECT 0, side, host, {1 - damping!r} * seed, 0.0::DOUBLE, 0.0::DOUBLE, false FROM start
  UNION ALL (
    WITH cur AS (SELECT * FROM walk WHERE NOT done),
    parts AS (
      SELECT f.side, f.dst AS host, {damping} * c.score * f.share AS score, 0.0::DOUBLE AS one, 0.0::DOUBLE AS two
        FROM cur c JOIN flow f ON f.side = c.side AND f.src = c.host
      UNION ALL SELECT side, host, {1 - damping!r} * seed, 0.0, 0.0 FROM start WHERE EXISTS (SELECT 1 FROM cur)
      UNION ALL SELECT side, host, 0.0, score, one FROM cur),
    next AS (SELECT (SELECT max(n) + 1 FROM cur) AS n, side, host, sum(score) AS score, max(one) AS one, max(two) AS two FROM parts GROUP BY side, host)
    SELECT n, side, host, score, one, two, n % {CUT_EVERY} = 0 AND NOT bool_or(score > two * {1 + TOLERANCE!r}) OVER () FROM next)),
scores AS (SELECT host, coalesce(sum(score) FILTER (side = 0), 0) AS trust, coalesce(sum(score) FILTER (side = 1), 0) AS distrust FROM walk WHERE done GROUP BY host)
SELECT page_id, host, path, rule,
    coalesce(rverdict, CASE WHEN coalesce(distrust, 0) > {threshold * (1 + TIE)!r} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
    round(coalesce(trust, 0), {digits}) AS trust, round(coalesce(distrust, 0), {digits}) AS distrust
FROM judged LEFT JOIN scores USING (host)"""
