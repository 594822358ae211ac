"""Vector search, prototype classification and classification metrics over
the ``embeddings`` table (64-d unit vectors, labels 0-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportlake.operators import classify, hashed, metrics, tfidf, vectors
from supportlake.operators.pairs import without_ids
from supportlake.plans import oracle as sq
from supportlake.plans.registry import query
from supportlake.session import cut_lineage
from supportlake.sources.tables import table

TOP_K = 3
# The driver's vectors are random-like: their top-3 similarities sit around
# 0.26-0.49, so the evidence floor for this table is a parameter of 0.35
# (the 0.55 default would keep nothing).
EVIDENCE_THRESHOLD = 0.35
PROTOTYPES_PER_LABEL = 4  # three exemplars + one description per intent
LABELS = [str(i) for i in range(10)]

EMB_CTE = """e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v0 FROM embeddings),
e AS (SELECT vec_id, label, list_transform(v0, lambda x: x / sqrt(list_sum(list_transform(v0, lambda y: y * y)))) AS v
      FROM e0)"""

TOPK_SQL = f"""{EMB_CTE},
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.v, d.v) AS sim
      FROM e q JOIN e d ON q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM s)"""

PROTO_SQL = f"""{EMB_CTE},
p0 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM e),
p AS (SELECT label AS proto_label, v, row_number() OVER (ORDER BY label, vec_id) AS proto_ord
      FROM p0 WHERE rn <= {PROTOTYPES_PER_LABEL}),
s AS (SELECT e.vec_id, e.label, p.proto_label, p.proto_ord, list_inner_product(e.v, p.v) AS sim FROM e JOIN p ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, proto_ord) AS rk FROM s),
pred AS (SELECT vec_id, CAST(label AS VARCHAR) AS y_true, CAST(proto_label AS VARCHAR) AS y_pred,
                round(greatest(0.0, least(1.0, (sim + 1) / 2)), 4) AS confidence FROM r WHERE rk = 1),
scored AS (SELECT * FROM pred WHERE vec_id NOT IN (SELECT vec_id FROM p0 WHERE rn <= {PROTOTYPES_PER_LABEL}))"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def self_topk(spark: SparkSession, sf_dir: str, k: int = TOP_K, strategy: str = "auto") -> DataFrame:
    e = embeddings(spark, sf_dir)
    return vectors.exact_topk(e, e, k, query_id="vec_id", doc_id="vec_id", exclude_self=True, strategy=strategy)


def prototypes(emb: DataFrame, per_label: int = PROTOTYPES_PER_LABEL) -> DataFrame:
    """First ``per_label`` vectors of each label: a bounded anchor table
    (partial top-k per label, then a window over labels x per_label rows)."""
    w = Window.partitionBy("label").orderBy("vec_id")
    p = emb.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label)
    return p.select(F.row_number().over(Window.orderBy("label", "vec_id")).cast("long").alias("proto_ord"),
                    F.col("label").alias("proto_label"), "vec_id", "embedding")


def prototype_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    protos = prototypes(e)
    best = vectors.exact_topk(e, protos, 1, query_id="vec_id", doc_id="proto_ord")
    labels = F.broadcast(protos.select(F.col("proto_ord").alias("doc_id"), "proto_label"))
    j = best.join(labels, "doc_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return j.select(F.col("query_id").alias("vec_id"), F.col("label").cast("string").alias("y_true"),
                    F.col("proto_label").cast("string").alias("y_pred"),
                    classify.confidence_from_cosine(F.col("similarity")).alias("confidence"))


@query("vector_topk", f"WITH {TOPK_SQL} SELECT query_id, doc_id, rank, round(sim, 4) AS similarity FROM r "
                      f"WHERE rank <= {TOP_K}")
def q_vector_topk(spark, sf_dir):
    t = self_topk(spark, sf_dir)
    return t.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                    F.round("similarity", 4).alias("similarity"))


@query("vector_topk_cells", f"WITH {TOPK_SQL} SELECT query_id, doc_id, rank, round(sim, 4) AS similarity FROM r "
                            f"WHERE rank <= {TOP_K}")
def q_vector_topk_cells(spark, sf_dir):
    """The same neighbours by visiting cells, as for an index of any size."""
    t = self_topk(spark, sf_dir, strategy="cells")
    return t.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                    F.round("similarity", 4).alias("similarity"))


HASHED = 256


def _hashed_cte(source: str, ids: str) -> str:
    """Hashed text vectors of ``source``: ``entries`` (ids..., bucket, weight)."""
    return f"""tok AS (SELECT {ids}, unnest(regexp_extract_all(lower(coalesce(text, '')), {sq.lit(tfidf.TOKEN_PATTERN)})) AS w FROM {source}),
tf AS (SELECT {ids}, (('0x' || md5(w)[1:8])::BIGINT % {HASHED})::INTEGER AS bucket, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT bucket, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY bucket),
raw AS (SELECT {ids}, bucket, tf * idf AS w FROM tf JOIN idf USING (bucket)),
entries AS (SELECT {ids}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {ids})) AS weight FROM raw)"""


@query("hashed_documents", lambda: f"WITH {_hashed_cte('documents', 'doc_id')} SELECT doc_id, bucket, round(weight, 6) AS weight FROM entries")
def q_hashed_documents(spark, sf_dir):
    """Hashed vectors of whole documents, one row per entry."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hashed.fit(d, "text", HASHED).entries(d, "text", ["doc_id"]).withColumn("weight", F.round("weight", 6))


@query("hashed_turns", lambda: f"WITH {_hashed_cte('conversations', 'conv_id, turn')} SELECT conv_id, turn, bucket, round(weight, 6) AS weight FROM entries")
def q_hashed_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return hashed.fit(c, "text", HASHED).entries(c, "text", ["conv_id", "turn"]).withColumn("weight", F.round("weight", 6))


@query("similar_turns", lambda: f"""WITH {_hashed_cte('conversations', 'conv_id, turn')},
u AS (SELECT e.*, conv_id * 1000 + turn AS id FROM entries e JOIN conversations c USING (conv_id, turn) WHERE role = 'user'),
every AS (SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'user'),
dot AS (SELECT a.id AS query_id, b.id AS doc_id, sum(a.weight * b.weight) AS sim FROM u a JOIN u b ON a.bucket = b.bucket GROUP BY ALL),
r AS (SELECT q.id AS query_id, d.id AS doc_id, coalesce(sim, 0.0) AS sim,
        row_number() OVER (PARTITION BY q.id ORDER BY round(coalesce(sim, 0.0), 9) DESC, d.id) AS rank
      FROM every q JOIN every d ON q.id <> d.id LEFT JOIN dot ON dot.query_id = q.id AND dot.doc_id = d.id)
SELECT query_id, doc_id, rank, round(sim, 4) AS similarity FROM r WHERE rank <= {TOP_K}""")
def q_similar_turns(spark, sf_dir):
    """The most similar other user turns of every user turn: hashed text vectors,
    searched by cells."""
    c = table(spark, sf_dir, "conversations")
    encoder = hashed.fit(c, "text", HASHED)
    users = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    v = cut_lineage(encoder.with_vector(users, "text").select("id", "embedding"))
    top = vectors.exact_topk(v, v, TOP_K, query_id="id", doc_id="id", exclude_self=True, strategy="cells")
    return top.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


@query("evidence_threshold", f"""WITH {TOPK_SQL}
SELECT query_id, count(*) AS n_hits, round(max(sim), 4) AS max_similarity FROM r
WHERE rank <= {TOP_K} AND sim >= {EVIDENCE_THRESHOLD} GROUP BY query_id""")
def q_evidence_threshold(spark, sf_dir):
    t = vectors.apply_threshold(self_topk(spark, sf_dir), EVIDENCE_THRESHOLD)
    return t.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"),
                                     F.round(F.max("similarity"), 4).alias("max_similarity"))


@query("prototype_classify", f"WITH {PROTO_SQL} SELECT vec_id, y_true, y_pred, confidence FROM pred")
def q_prototype_classify(spark, sf_dir):
    return prototype_predictions(spark, sf_dir)


def _counts(spark, sf_dir):
    """Predictions against labels, without the anchors (each is its own nearest)."""
    anchors = prototypes(embeddings(spark, sf_dir)).select("vec_id")
    return metrics.pair_counts(without_ids(prototype_predictions(spark, sf_dir), anchors, "vec_id"), "y_true", "y_pred")


_LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_PER_CLASS_SQL = f"""{PROTO_SQL},
c AS (SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL),
spine AS (SELECT unnest({_LABELS_SQL}) AS label),
tp AS (SELECT y_true AS label, sum(n) AS tp FROM c WHERE y_true = y_pred GROUP BY 1),
sup AS (SELECT y_true AS label, sum(n) AS support FROM c GROUP BY 1),
pc AS (SELECT y_pred AS label, sum(n) AS pred_n FROM c GROUP BY 1),
pcl AS (SELECT s.label, coalesce(tp.tp, 0) AS tp, coalesce(sup.support, 0) AS support, coalesce(pc.pred_n, 0) AS pred_n
        FROM spine s LEFT JOIN tp USING (label) LEFT JOIN sup USING (label) LEFT JOIN pc USING (label)),
m AS (SELECT label,
        CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
        CASE WHEN support + pred_n > 0 THEN 2 * tp / (support + pred_n) ELSE 0.0 END AS f1, support FROM pcl)"""


@query("intent_report", f"""WITH {_PER_CLASS_SQL},
u AS (SELECT label, precision, recall, f1, support FROM m
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support) FROM m
      UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM pcl)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM u""")
def q_intent_report(spark, sf_dir):
    return metrics.report_with_averages(_counts(spark, sf_dir), LABELS)


@query("confusion_matrix", f"""WITH {PROTO_SQL},
c AS (SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL),
spine AS (SELECT t.true_label, unnest({_LABELS_SQL}) AS pred_label FROM (SELECT unnest({_LABELS_SQL}) AS true_label) t)
SELECT s.true_label, s.pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM spine s LEFT JOIN c ON s.true_label = c.y_true AND s.pred_label = c.y_pred""")
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_long(_counts(spark, sf_dir), LABELS)


@query("macro_f1", f"""WITH {PROTO_SQL},
c AS (SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL),
labs AS (SELECT y_true AS label FROM c UNION SELECT y_pred FROM c),
tp AS (SELECT y_true AS label, sum(n) AS tp FROM c WHERE y_true = y_pred GROUP BY 1),
sup AS (SELECT y_true AS label, sum(n) AS support FROM c GROUP BY 1),
pc AS (SELECT y_pred AS label, sum(n) AS pred_n FROM c GROUP BY 1),
f AS (SELECT l.label, coalesce(sup.support, 0) AS support,
        CASE WHEN coalesce(sup.support, 0) + coalesce(pc.pred_n, 0) > 0
             THEN 2 * coalesce(tp.tp, 0) / (coalesce(sup.support, 0) + coalesce(pc.pred_n, 0)) ELSE 0.0 END AS f1
      FROM labs l LEFT JOIN tp USING (label) LEFT JOIN sup USING (label) LEFT JOIN pc USING (label))
SELECT round((SELECT sum(n) FILTER (WHERE y_true = y_pred) / sum(n) FROM c), 4) AS accuracy,
       round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1,
       CAST((SELECT sum(n) FROM c) AS BIGINT) AS n
FROM f""")
def q_macro_f1(spark, sf_dir):
    return metrics.intent_summary(_counts(spark, sf_dir))
