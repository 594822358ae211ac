"""Secret scans by corpus-wide ownership frequency.

Three base patterns find spans in every text: assignments to a secret-like
name, access key ids and long hex runs.  Their values, and any other long run
of key characters, are candidates.  Only the SHA-256 of a candidate leaves the
scan; hashes are aggregated by distinct repositories and owners over the whole
corpus.  A value that many owners hold is a copied example.  A value that at
most ``max_owners`` owners hold and that looks live (letters and digits, enough
different characters, no placeholder word) is a credential of its owner: its
span is added as kind ``live``.

Everything is DataFrame functions.  Spark's regular expressions give matches,
not places; a place is the running sum of the lengths of the stretches between
matches (``split`` on the same pattern) and of the matches before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.llm.spread import join_dealt
from supportlake.session import cut_lineage


def _either_case(pattern: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


# kinds in the order of the contract (fixed values); runs are matched from their least length on, which gives the
# same spans as matching every run, but a short assignment still uses up its text and is dropped afterwards
ASSIGN = _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12

KEY = "[A-Za-z0-9+/_-]{20,}"             # candidates that are in no base span
PLACEHOLDER = _either_case("example|sample|dummy|placeholder|changeme|your|xxxx")
LEAST_DIFFERENT = 8                      # different characters of a live-looking value
MAX_OWNERS = 2
KINDS = ("assign", "access", "hex", "live")
RUN = 512                                # lengths summed up at once, see _running


def _sums(lengths: Column, start: Column) -> Column:
    """Running sums from ``start`` on."""
    return F.aggregate(
        lengths, F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")),
        lambda a: a["out"])


def _running(lengths: Column) -> Column:
    """Running sums of an array of any length: appending copies the array, so
    it is done in stretches of RUN, each from the sum of those before it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")),
                         lambda b: F.slice(lengths, b * RUN + 1, RUN))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    zero = F.lit(0).cast("long")
    return F.flatten(F.zip_with(
        blocks, F.concat(F.array(zero), _sums(F.transform(blocks, total), zero)),
        lambda b, at: F.when(b.isNotNull(), _sums(b, at)).otherwise(F.expr("cast(array() as array<bigint>)"))))


def _length(x: Column) -> Column:
    return F.length(x).cast("long")


def looks_live(value: Column) -> Column:
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
            & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT))


def find(docs: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column) -> DataFrame:
    """(doc_id, repository, owner, base, cands), one row per row: base spans
    (start, kind's number, stop) in order, and candidates (hash, start, stop, live)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(repository, F.lit("")).alias("repository"),
                       F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY}
    rows = rows.withColumns({k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    gaps = {}
    for k, p in patterns.items():
        between = F.transform(F.slice(F.split("text", p, -1), 1, F.size(k)), _length)
        gaps[f"{k}_steps"] = F.when(F.size(k) > 0, F.zip_with(between, F.transform(k, _length), lambda a, b: a + b))
    gaps["assign_value"] = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)))
    rows = rows.withColumns(gaps).drop("text")
    rows = rows.withColumns({f"{k}_stop": F.when(F.size(k) > 0, _running(F.col(f"{k}_steps"))) for k in patterns}).drop(
        *[f"{k}_steps" for k in patterns])
    none = "cast(array() as array<struct<value: string, start: bigint, stop: bigint, whole: bigint>>)"
    found = {}
    for k in patterns:                   # start and stop of the value; whole is the start of the match
        value = "assign_value" if k == "assign" else k
        spans = F.transform(F.arrays_zip(F.col(k).alias("m"), F.col(value).alias("v"), F.col(f"{k}_stop").alias("stop")), lambda x: F.struct(
            x["v"].alias("value"), (x["stop"] - _length(x["v"])).alias("start"), x["stop"].alias("stop"),
            (x["stop"] - _length(x["m"])).alias("whole")))
        found[k] = F.when(F.size(k) > 0, spans).otherwise(F.expr(none))
    found["assign"] = F.filter(found["assign"], lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    rows = rows.select("doc_id", "repository", "owner", *[c.alias(k) for k, c in found.items()])
    of_kind = lambda i: lambda x: F.struct(x["whole"].alias("start"), F.lit(i).alias("kind"), x["stop"].alias("stop"))
    base = F.array_sort(F.concat(*[F.transform(k, of_kind(i)) for i, k in enumerate(KINDS[:3])]))
    cands = F.array_distinct(F.transform(F.concat(*patterns), lambda x: F.struct(
        F.sha2(x["value"], 256).alias("hash"), x["start"].alias("start"), x["stop"].alias("stop"), looks_live(x["value"]).alias("live"))))
    return rows.select("doc_id", "repository", "owner", base.alias("base"), cands.alias("cands"))


def ownership(cands: DataFrame) -> DataFrame:
    """(hash, repositories, owners, n, live) of ``cands`` (hash, repository,
    owner, live): a repository is named within its owner.  Every step is summed
    before its shuffle, so a value in a third of all rows is as cheap as any."""
    each = cands.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"), F.first("live").alias("live"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.first("live").alias("live"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"),
                                      F.sum("n").alias("n"), F.first("live").alias("live"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def owner_of(source: Column) -> Column:
    """What stands before the first slash of a repository's name, else the name."""
    return F.substring_index(source, "/", 1)


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, id_col: str = "doc_id", text_col: str = "text",
         repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_copied), one row per row of ``docs``.  Spans are kind:start:stop in code
    points, stop exclusive, by start, then kind, comma-joined.  ``repository``
    and ``owner`` say whose a document is (default: column ``source`` and what
    stands before its first slash).  n_live counts the added spans, n_copied
    the live-looking candidates that more than ``max_owners`` owners hold.

    Defined cases: null and empty texts have no spans (the digest of no bytes);
    a null id comes back null; repeated rows each come back and count as one
    owner; a null repository or owner is the unnamed one; the ends of spans
    that begin together are in rising order; an empty table gives an empty one;
    other columns are not looked at."""
    source = F.col("source").cast("string")
    repository = source if repository is None else repository
    owner = owner_of(source) if owner is None else owner
    found = cut_lineage(find(docs, id_col, text_col, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    cands = found.select("row", "repository", "owner", F.inline("cands"))
    held = cut_lineage(ownership(cands))
    total = held.agg(F.sum("n")).first()[0] or 0
    verdicts = held.where("live").select("hash", "n", (F.col("owners") <= max_owners).alias("own"))
    met = join_dealt(cands.where("live").select("row", "hash", "start", "stop"), verdicts, "hash", total, F.xxhash64("row", "start"))
    # a row's own candidates: no more than its text holds
    added = met.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(F.col("own"), F.struct("start", F.lit(3).alias("kind"), "stop")))).alias("live"),
        F.count_if(~F.col("own")).alias("n_copied"))
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, stop: bigint>>)")
    live = F.coalesce("live", none)
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.join(added, "row", "left").select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", live))).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def oracle_sql(max_owners: int = MAX_OWNERS) -> str:
    """The same rows as one DuckDB statement over ``documents``."""
    q = lambda p: p.replace("'", "''")
    spans = lambda k, pattern, value: f"""
{k} AS (SELECT row, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 'v': v[i], 'stop':
    list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x)))}})) AS x
  FROM (SELECT row, regexp_extract_all(t, '{q(pattern)}') AS m, regexp_extract_all(t, '{q(pattern)}', {value}) AS v,
      string_split_regex(t, '{q(pattern)}') AS g FROM d) WHERE len(m) > 0)"""  # noqa: E731
    each = lambda k, i: (f"SELECT row, {i} AS kind, x.v AS v, (x.stop - length(x.v))::BIGINT AS start, x.stop::BIGINT AS stop, "  # noqa: E731
                         f"(x.stop - length(x.m))::BIGINT AS whole FROM {k}")
    text = "string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS repository, coalesce(split_part(source, '/', 1), '') AS owner,
    coalesce(text, '') AS t FROM documents),{spans('f0', ASSIGN, 2)},{spans('f1', ACCESS, 0)},{spans('f2', HEX, 0)},{spans('f3', KEY, 0)},
f AS ({each('f0', 0)} WHERE length(x.v) >= {ASSIGN_LEAST} UNION ALL {each('f1', 1)} UNION ALL {each('f2', 2)} UNION ALL {each('f3', 3)}),
base AS (SELECT row, kind, whole AS start, stop FROM f WHERE kind < 3),
c AS (SELECT DISTINCT row, sha256(v) AS hash, start, stop, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT regexp_matches(v, '{PLACEHOLDER}') AND len(list_distinct(string_split(v, ''))) >= {LEAST_DIFFERENT} AS live FROM f),
o AS (SELECT hash, count(DISTINCT owner) AS owners FROM c JOIN d USING (row) GROUP BY hash),
l AS (SELECT c.*, owners <= {max_owners} AS own FROM c JOIN o USING (hash) WHERE live),
a AS (SELECT DISTINCT row, 3 AS kind, start, stop FROM l WHERE own),
b AS (SELECT row, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {text} AS s FROM base GROUP BY row),
e AS (SELECT row, {text} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM a) GROUP BY row),
n AS (SELECT row, count(*) FILTER (NOT own) AS n_copied FROM l GROUP BY row),
m AS (SELECT row, count(*) AS n_live FROM a GROUP BY row)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
    sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN b USING (row) LEFT JOIN e USING (row) LEFT JOIN n USING (row) LEFT JOIN m USING (row)"""
