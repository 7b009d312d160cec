"""The queries of this subpackage, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm import bpe, knn_forest, overlap, packing, quota, reach, sentences, split
from stipple.llm.common import current_rows, finite


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def _plain(name: str) -> Column:
    """A spelling in lower case without blanks of any kind."""
    return F.lower(F.regexp_replace(name, r"[\s\u00a0]+", ""))


# --- scans in pieces


def _pieces(spark: SparkSession, at: str) -> DataFrame:
    scans = current_rows(_table(spark, at, "scans"), ["cloud_id"], ["dataset"])
    budgets = _table(spark, at, "size_budgets").filter("unit = 'points'").select(F.col("applies_to").alias("dataset"), "capacity", "overlap", "reach")
    return split.split_oversized(_table(spark, at, "points"), scans.join(F.broadcast(budgets), "dataset"))


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    """The smallest node of every body of at least 10 nodes of the scans that had to be cut, put together again from the pieces."""
    own = _pieces(spark, at).filter("not shared").groupBy("cloud_id", "body").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n"))
    return own.filter("n >= 10").select("cloud_id", "node_id")


def p1_pieces(spark: SparkSession, at: str) -> DataFrame:
    """``(cloud_id, piece, seq, node_id, body, shared)``: the pieces, point by point."""
    return _pieces(spark, at).drop("body_size")


def p1_limits(spark: SparkSession, at: str) -> DataFrame:
    """``(cloud_id, nodes, fits)``: the nodes of each scan that was cut, each once, and whether all its pieces are within the capacity."""
    scans = current_rows(_table(spark, at, "scans"), ["cloud_id"], ["dataset"])
    budgets = _table(spark, at, "size_budgets").filter("unit = 'points'").select(F.col("applies_to").alias("dataset"), "capacity")
    sizes = _pieces(spark, at).groupBy("cloud_id", "piece").agg(F.count("*").alias("n"), F.count_if(~F.col("shared")).alias("own"))
    sizes = sizes.groupBy("cloud_id").agg(F.sum("own").alias("nodes"), F.max("n").alias("most"))
    return sizes.join(scans, "cloud_id").join(F.broadcast(budgets), "dataset").select("cloud_id", "nodes", (F.col("most") <= F.col("capacity")).alias("fits"))


# --- vectors of feature_nodes


def usable_features(spark: SparkSession, at: str) -> DataFrame:
    """``(node_id, pos)`` of the usable feature nodes: the current pos has exactly 20 finite values."""
    return current_rows(_table(spark, at, "feature_nodes"), ["node_id"], ["pos"]).filter(finite(F.col("pos"), 20))


def p2_knn(spark: SparkSession, at: str) -> DataFrame:
    """``(node_id, edge_index, dist)``: the 5 nearest other usable nodes, nearest first."""
    edges = knn_forest.knn_forest(usable_features(spark, at), "node_id", "pos", 20, k=5)
    row = F.array_sort(F.collect_list(F.struct("rank", "neighbor", "dist")))
    return edges.groupBy(F.col("node").alias("node_id")).agg(row.alias("r")).select("node_id", F.col("r.neighbor").alias("edge_index"), F.transform("r.dist", lambda d: F.round(d, 6)).alias("dist"))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    """Each pair of nodes at most 10 apart of which one is among the other's 5 nearest."""
    edges = knn_forest.knn_forest(usable_features(spark, at), "node_id", "pos", 20, k=5, radius=10.0)
    near = edges.filter(F.col("dist") <= 10.0)
    return near.select(F.least("node", "neighbor").alias("node_a"), F.greatest("node", "neighbor").alias("node_b")).distinct()


def _feature_groups(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    nodes = usable_features(spark, at)
    return nodes, reach.reach_groups(nodes, "node_id", "pos", 20, reach=10.0)


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    """The smallest node of each group of at least 10 nodes, paired with each other member."""
    _, groups = _feature_groups(spark, at)
    large = groups.groupBy("label").count().filter("count >= 10").select("label")
    return groups.join(large, "label").filter("id <> label").select(F.col("label").alias("anchor_id"), F.col("id").alias("node_id"))


def p5_clusters(spark: SparkSession, at: str) -> DataFrame:
    """``(anchor_id, size, typical)``: each group, lone nodes among them, with its size and most typical nodes."""
    nodes, groups = _feature_groups(spark, at)
    return reach.describe_groups(nodes, groups, "node_id", "pos", 20, cell=10.0, least=1)


def p5_members(spark: SparkSession, at: str) -> DataFrame:
    """``(node_id, anchor_id)``: every usable node with the smallest node of its group, which may be itself."""
    _, groups = _feature_groups(spark, at)
    return groups.select(F.col("id").alias("node_id"), F.col("label").alias("anchor_id"))


# --- samples of objects


def training_labels(spark: SparkSession, at: str) -> DataFrame:
    """``(object_id, dataset, y)`` of the current ModelNet40 and ScanObjectNN records in train, however spelled."""
    rows = current_rows(_table(spark, at, "objects"), ["object_id"], ["dataset", "split", "y"])
    return rows.filter(_plain("split") == "train").filter(F.col("dataset").isin("ModelNet40", "ScanObjectNN")).select("object_id", "dataset", "y")


def _quota(spark: SparkSession, at: str) -> quota.QuotaSample:
    return quota.QuotaSample(training_labels(spark, at), _table(spark, at, "target_shares"), ["dataset", "y"], ["dataset"], "object_id")


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    """Classes with fewer eligible records than their share or floor asks for."""
    return _quota(spark, at).report().filter("not met").select("dataset", "y")


def p3_report(spark: SparkSession, at: str) -> DataFrame:
    """Every class with what is eligible, what is required, what the sample takes, and whether it is met."""
    return _quota(spark, at).report().withColumn("required", F.round("required", 6))


def p3_sample(spark: SparkSession, at: str) -> DataFrame:
    """``(object_id, dataset, y)``: the sample."""
    return _quota(spark, at).sample().select("object_id", "dataset", "y")


def p3_limits(spark: SparkSession, at: str) -> DataFrame:
    """``(dataset, sampled, floors)``: rows of the sample, and whether every class has its floor as far as it goes."""
    q = _quota(spark, at)
    drawn = q.sample().groupBy("dataset", "y").agg(F.count("*").alias("n"))
    rows = q.report().join(drawn, ["dataset", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("dataset").agg(F.sum("n").alias("sampled"), F.every(F.col("n") >= F.least("min_rows", "eligible")).alias("floors"))


# --- shapes across splits


def shape_records(spark: SparkSession, at: str) -> DataFrame:
    """``(object_id, dataset, split, source, pos, train)`` of the current objects; the split in lower case without blanks."""
    rows = current_rows(_table(spark, at, "objects"), ["object_id"], ["dataset", "split", "source", "pos"])
    return rows.withColumn("split", _plain("split")).withColumn("train", F.coalesce(F.col("split") == "train", F.lit(False)))


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    """Pairs of records of the same shape, exactly one of them in train."""
    pairs = overlap.near_copies(shape_records(spark, at), "object_id", "pos", "train")
    return pairs.select(F.least("eval_id", "train_id").alias("object_a"), F.greatest("eval_id", "train_id").alias("object_b"))


def p4_report(spark: SparkSession, at: str) -> DataFrame:
    """``(split, source, records, overlapping, pairs)``: overlaps with train per evaluation split and source."""
    rows = shape_records(spark, at)
    pairs = overlap.near_copies(rows, "object_id", "pos", "train")
    each = pairs.groupBy(F.col("eval_id").alias("object_id")).agg(F.count("*").alias("n"))
    held = rows.filter("not train").select("object_id", "split", "source").join(each, "object_id", "left")
    return held.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


# --- tokens of documents


def p6_ids(spark: SparkSession, at: str, tokenizer: str = bpe.TOKENIZER) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(_table(spark, at, "documents"), tokenizer=tokenizer)


def p7_packed(spark: SparkSession, at: str, tokenizer: str = bpe.TOKENIZER) -> DataFrame:
    """Every document, or piece of one, in a container of each token capacity."""
    counts = bpe.token_counts(_table(spark, at, "documents"), tokenizer=tokenizer)
    budgets = _table(spark, at, "size_budgets").filter("applies_to = 'documents' and unit = 'tokens'").select("budget_id", "capacity").collect()
    return packing.pack(counts, {r["budget_id"]: r["capacity"] for r in budgets})


def p7_limits(spark: SparkSession, at: str, tokenizer: str = bpe.TOKENIZER) -> DataFrame:
    """``(budget_id, documents, overfull)``: documents in containers or of no tokens, and containers above their capacity."""
    packed = p7_packed(spark, at, tokenizer)
    budgets = _table(spark, at, "size_budgets").filter("applies_to = 'documents' and unit = 'tokens'").select("budget_id", "capacity")
    held = packed.groupBy("budget_id", "container_id").agg(F.sum("n_units").alias("n")).join(F.broadcast(budgets), "budget_id")
    over = held.filter("container_id is not null").groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    return packed.filter("piece = 0").groupBy("budget_id").agg(F.count("*").alias("documents")).join(over, "budget_id").select("budget_id", "documents", "overfull")


# --- sentences of documents


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    """The first character of every sentence, headline and advert sentence."""
    return sentences.sentence_units(_table(spark, at, "documents")).select("doc_id", "start_char")


def p8_units(spark: SparkSession, at: str) -> DataFrame:
    """``(doc_id, unit, start_char, end_char, spans, text)``: every unit with its end, spans and whole text."""
    return sentences.sentence_units(_table(spark, at, "documents"), whole=True)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_limits, p2_found, p2_knn, p3_found, p3_report, p3_sample, p3_limits, p4_found, p4_report, p5_found, p5_clusters, p5_members, p6_ids, p7_packed, p7_limits, p8_found, p8_units)}


def oracle_sql() -> dict[str, str]:
    d2 = " + ".join(f"(a.pos[{i}]::double - b.pos[{i}]::double) ** 2" for i in range(1, 21))
    return {
        "p1_found": _P1,
        "p2_found": _P2.format(nodes=_NODES, d2=d2),
        "p3_found": _P3.format(last="SELECT dataset, y FROM counted WHERE eligible < required"),
        "p1_limits": _P1_LIMITS,
        "p3_limits": _P3.format(last=_P3_LIMITS),
        "p5_found": _P5.format(nodes=_NODES, d2=d2, last=_P5_FOUND),
        "p5_members": _P5.format(nodes=_NODES, d2=d2, last="SELECT node_id, label AS anchor_id FROM labels"),
        "p7_limits": _P7_LIMITS,
    }


_LARGE = """
scan_t AS (SELECT cloud_id, max(received_at) AS t FROM scans WHERE cloud_id IS NOT NULL GROUP BY cloud_id),
scan AS (SELECT s.cloud_id, max(s.dataset) AS dataset FROM scans s JOIN scan_t t ON s.cloud_id = t.cloud_id AND s.received_at IS NOT DISTINCT FROM t.t GROUP BY s.cloud_id),
latest AS (SELECT cloud_id, node_id, max(received_at) AS t FROM points WHERE cloud_id IS NOT NULL AND node_id IS NOT NULL GROUP BY cloud_id, node_id),
cur AS (SELECT p.cloud_id, p.node_id, max(p.pos) AS pos FROM points p JOIN latest l
        ON p.cloud_id = l.cloud_id AND p.node_id = l.node_id AND p.received_at IS NOT DISTINCT FROM l.t GROUP BY p.cloud_id, p.node_id),
usable AS (SELECT cloud_id, node_id, pos[1]::double AS x, pos[2]::double AS y, pos[3]::double AS z FROM cur
           WHERE len(pos) = 3 AND len([v for v in pos if isfinite(v)]) = 3),
large AS (SELECT u.cloud_id, any_value(b.reach) AS reach, count(*) AS nodes FROM usable u JOIN scan s ON u.cloud_id = s.cloud_id
          JOIN size_budgets b ON s.dataset = b.applies_to AND b.unit = 'points' GROUP BY u.cloud_id HAVING count(*) > any_value(b.capacity)),
"""

_P1_LIMITS = f"""
WITH {_LARGE.strip().rstrip(",")}
SELECT cloud_id, nodes, true AS fits FROM large"""

_P1 = f"""
WITH RECURSIVE {_LARGE}
nodes AS (SELECT u.*, l.reach FROM usable u JOIN large l ON u.cloud_id = l.cloud_id),
links AS (SELECT a.cloud_id, a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.cloud_id = b.cloud_id AND a.node_id <> b.node_id
          WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= a.reach ** 2),
labels(cloud_id, node_id, label) USING KEY (cloud_id, node_id) AS (
  SELECT cloud_id, node_id, node_id FROM nodes
  UNION
  SELECT l.cloud_id, l.b, min(r.label) FROM labels r JOIN links l ON r.cloud_id = l.cloud_id AND r.node_id = l.a
  JOIN recurring.labels c ON c.cloud_id = l.cloud_id AND c.node_id = l.b WHERE r.label < c.label GROUP BY l.cloud_id, l.b)
SELECT cloud_id, label AS node_id FROM labels GROUP BY cloud_id, label HAVING count(*) >= 10"""

_NODES = """
latest AS (SELECT node_id, max(received_at) AS t FROM feature_nodes WHERE node_id IS NOT NULL GROUP BY node_id),
cur AS (SELECT f.node_id, max(f.pos) AS pos FROM feature_nodes f JOIN latest l ON f.node_id = l.node_id AND f.received_at IS NOT DISTINCT FROM l.t GROUP BY f.node_id),
nodes AS (SELECT node_id, pos FROM cur WHERE len(pos) = 20 AND len([v for v in pos if isfinite(v)]) = 20)"""

_P2 = """
WITH {nodes},
pairs AS (SELECT a.node_id AS a, b.node_id AS b, {d2} AS d2 FROM nodes a JOIN nodes b ON a.node_id <> b.node_id),
ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM pairs WHERE d2 <= 100)
SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM ranked WHERE r <= 5"""

_P5 = """
WITH RECURSIVE {nodes},
links AS (SELECT a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.node_id <> b.node_id AND {d2} <= 100),
labels(node_id, label) USING KEY (node_id) AS (
  SELECT node_id, node_id FROM nodes
  UNION
  SELECT l.b, min(r.label) FROM labels r JOIN links l ON r.node_id = l.a JOIN recurring.labels c ON c.node_id = l.b WHERE r.label < c.label GROUP BY l.b)
{last}"""

_P5_FOUND = """, large AS (SELECT label FROM labels GROUP BY label HAVING count(*) >= 10)
SELECT l.label AS anchor_id, l.node_id FROM labels l JOIN large g ON l.label = g.label WHERE l.node_id <> l.label"""

_P7_LIMITS = """
SELECT budget_id, (SELECT count(*) FROM documents) AS documents, 0::bigint AS overfull
FROM size_budgets WHERE applies_to = 'documents' AND unit = 'tokens'"""

_P3_LIMITS = """,
sized AS (SELECT c.dataset, c.eligible, s.min_rows, s.target_share * s.sample_share * coalesce(m.total, 0) AS wanted
          FROM counted c JOIN target_shares s ON c.dataset = s.dataset AND c.y = s.y LEFT JOIN sums m ON c.dataset = m.dataset)
SELECT dataset, least(greatest(round_even(sum(wanted), 0)::bigint, sum(least(min_rows, eligible))::bigint), sum(eligible)::bigint) AS sampled, true AS floors
FROM sized GROUP BY dataset"""

_P3 = """
WITH latest AS (
  SELECT object_id, max(received_at) AS t FROM objects WHERE object_id IS NOT NULL GROUP BY object_id),
rows_now AS (
  SELECT o.object_id, max(o.dataset) AS dataset, max(o.split) AS split, max(o.y) AS y
  FROM objects o JOIN latest l ON o.object_id = l.object_id AND o.received_at IS NOT DISTINCT FROM l.t GROUP BY o.object_id),
eligible AS (
  SELECT r.dataset, r.y, count(*) AS n FROM rows_now r JOIN target_shares s ON r.dataset = s.dataset AND r.y = s.y
  WHERE lower(regexp_replace(r.split, '\\s+', '', 'g')) = 'train' GROUP BY r.dataset, r.y),
sums AS (SELECT dataset, sum(n) AS total FROM eligible GROUP BY dataset),
counted AS (
  SELECT s.dataset, s.y, coalesce(e.n, 0) AS eligible,
         greatest(s.target_share * s.sample_share * coalesce(m.total, 0), s.min_rows) AS required
  FROM target_shares s LEFT JOIN eligible e ON s.dataset = e.dataset AND s.y = e.y LEFT JOIN sums m ON s.dataset = m.dataset)
{last}
"""
