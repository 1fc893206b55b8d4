"""Hard negatives of labelled vectors, by an exact kNN join over Voronoi cells.

Inner products become distances once every vector has one component more: the root of what its squared norm lacks of the
largest one (an anchor gets 0). Each row belongs to the cell of its nearest pivot, and to a ring of that cell by its
distance. The triangle inequality bounds how near an anchor can be to a block, that is to a ring of a cell; what an anchor
still needs is bounded by its best rows of a small sample. So a row is sent only to the groups of anchors that a row of its
block might serve, and there it is compared by a matrix product. Both searches, that for positives (rows of the same label)
and that for negatives (rows of another label in a band of scores below the positive's), are made so.

The sample (SAMPLE rows, fewer if vectors are long) gives pivots and bounds only: every row is indexed, and results are
exact. Anchors are dealt in groups of about GROUP and a group's rows in parts of about PART, so no task gathers a cell, however
many rows one vector has; a part keeps its best few for each anchor, and these are merged by rank.

Rows without a label, without a vector, or with a null or non-finite component take no part, nor do those whose squared norm
after rounding reaches 2**62, as scores are whole 64-bit numbers. A shorter vector counts as filled up with zeros, and an empty
one as zeros. Repeated rows are rows each, but a repeated anchor is one, and rows of an anchor's own id are neither its
positives nor its negatives. A null id is no anchor and the last among ties. A positive with a score of 0 takes negatives of 0,
one below 0 none. An anchor without positives or negatives, and an empty table, give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclemill.llm.shared import apart, stored, table, widened

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
PIVOTS, RINGS = 64, 32
#: Rows of the sample at most, and components of all of them together.
SAMPLE, SAMPLE_NUMBERS = 2048, 1 << 20
GROUP, PART = 256, 8192
NONE = np.iinfo(np.int64).min


def whole(df: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """df's rows that take part, with their vector as whole numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = df.where(F.col("label").isNotNull() & F.col(vector).isNotNull()).where(~odd)
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    some = some.where(F.aggregate(floors, F.lit(0.0), lambda a, x: a + x * x) < float(2**62))
    return some.withColumn(vector, F.transform(floors, lambda x: x.try_cast("int")))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, sizes = np.asarray(vectors.flatten()), np.asarray(pa.compute.list_value_length(vectors))
    out = np.zeros((len(vectors), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole vectors, exact: in doubles where no sum can leave their whole numbers."""
    most = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))
    if most < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def numbers(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which are null."""
    return np.asarray(pa.compute.fill_null(ids, 0)).astype(np.int64), np.asarray(pa.compute.is_null(ids))


@dataclass
class Space:
    """pivots: (at most PIVOTS, dim + 1). The sample's rows, in the order of their ids. low, high: per block the least and the
    greatest distance from its pivot of the rows in it."""

    dim: int
    top: float
    pivots: np.ndarray
    sample: np.ndarray
    ids: np.ndarray
    no_id: np.ndarray
    labels: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        norms = (x * x).sum(1)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.top - norms, 0))
        squares = (norms if anchors else np.full(len(x), self.top))[:, None] + (self.pivots**2).sum(1) - 2 * (x @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1])
        return np.sqrt(np.maximum(squares, 0))

    def blocks(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """(anchor, cell, ring): whether a row there can have a score from least to most with the anchor."""
        norms, slack = (x * x).sum(1), 1e-5 * np.sqrt(self.top) + 1e-9
        near, far = (np.sqrt(np.maximum(norms + self.top - 2 * s, 0)) for s in (most, least))
        d = self.distances(x, True)[:, :, None]
        below = np.maximum(np.maximum(d - self.high, self.low - d), 0)
        return (below <= far[:, None, None] + slack) & (d + self.high >= near[:, None, None] - slack)


def space(rows: DataFrame) -> Space | None:
    """Pivots, farthest first, out of a sample by hash. None if there are no rows."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    all_of = rows.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("top")).first()
    if all_of["dim"] is None:
        return None
    dim = max(1, all_of["dim"])
    found = rows.orderBy(F.xxhash64("vec_id", "v", "label"), "vec_id", "label", "v").select("vec_id", "label", "v").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))).toArrow()
    found = found.sort_by([("vec_id", "ascending")])
    ids, no_id = numbers(found["vec_id"].combine_chunks())
    out = Space(dim, all_of["top"], np.zeros((0, dim + 1)), matrix(found["v"], dim), ids, no_id, np.asarray(found["label"]))
    raised = np.hstack([out.sample, np.sqrt(np.maximum(out.top - (out.sample**2).sum(1), 0))[:, None]])
    chosen, left = [0], ((raised - raised[0]) ** 2).sum(1)
    while len(chosen) < PIVOTS and left.max() > 0:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, ((raised - raised[chosen[-1]]) ** 2).sum(1))
    out.pivots = raised[chosen]
    return out


def placed(rows: DataFrame, where: Space) -> DataFrame:
    """rows with row_, a number for each, cell, ring and distance."""
    names = rows.columns
    sent = rows.sparkSession.sparkContext.broadcast(where)  # bounded, see Space

    def run(batches):
        for batch in batches:
            d = sent.value.distances(matrix(batch.column("v"), sent.value.dim), False)
            cell = d.argmin(1)
            own = d[np.arange(len(d)), cell]
            ring = np.minimum(own / (2 * np.sqrt(sent.value.top) + 1e-300) * RINGS, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(own)], [*names, "cell", "ring", "distance"])

    return stored(rows.mapInArrow(run, widened(rows, "cell int, ring int, distance double")).withColumn("row_", F.monotonically_increasing_id()))


def grouped(anchors: DataFrame, by_label: bool) -> DataFrame:
    """anchors with group_label, bucket and chunk: near cells share a bucket, a large one is cut into chunks. Groups of a label each,
    or (group_label 0) of all."""
    label = F.col("label") if by_label else F.lit(0).cast("long")
    anchors = anchors.withColumn("group_label", label)
    sizes = anchors.groupBy("group_label", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group_label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = F.col("n") > GROUP
    buckets = sizes.select("group_label", "cell", F.when(large, -1 - F.col("cell").cast("long")).otherwise(F.floor(before / GROUP)).alias("bucket"), F.ceil(F.col("n") / GROUP).alias("chunks"))
    return anchors.join(buckets, ["group_label", "cell"]).withColumn("chunk", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("row_"), "chunks")).otherwise(0)).drop("chunks")


KEYS = ["group_label", "bucket", "chunk"]


def needed(anchors: DataFrame, where: Space, bounds) -> DataFrame:
    """(group, cell, ring): the blocks of which a row might serve an anchor of the group. bounds(space, x, batch) gives the scores from
    and to which each anchor of a batch looks."""
    sent = anchors.sparkSession.sparkContext.broadcast(where)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"), sent.value.dim)
            serves = sent.value.blocks(x, *bounds(sent.value, x, batch))
            groups = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in KEYS], 1)
            each, of = np.unique(groups, axis=0, return_inverse=True)
            for i, key in enumerate(each):
                cell, ring = np.nonzero(serves[of.ravel() == i].any(0))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(cell), k)) for k in key), pa.array(cell.astype(np.int32)), pa.array(ring.astype(np.int32))], [*KEYS, "cell", "ring"])

    return anchors.mapInArrow(run, ", ".join(f"{k} long" for k in KEYS) + ", cell int, ring int").distinct()


def met(anchors: DataFrame, rows: DataFrame, needs: DataFrame, by_label: bool, search, schema: str) -> DataFrame:
    """search(anchors, rows) of each group of anchors and each part of the rows sent to it."""
    needs = stored(needs)
    on = F.col("cell") == F.col("need_cell")
    on = on & (F.col("ring") == F.col("need_ring")) & ((F.col("label") == F.col("group_label")) if by_label else F.lit(True))
    named = needs.withColumnsRenamed({"cell": "need_cell", "ring": "need_ring"})
    counts = rows.groupBy("label", "cell", "ring").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(counts.join(named, on).groupBy(*KEYS).agg(F.ceil(F.sum("n") / PART).alias("parts")))
    dealt = named.join(parts, KEYS)  # a row for each group and block, as needs
    sent = rows.join(dealt, on).withColumn("part", F.pmod(F.xxhash64("row_"), "parts")).select(*KEYS, "part", "vec_id", "label", "v")
    each = anchors.join(parts, KEYS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return each.groupBy(*KEYS, "part").cogroup(sent.groupBy(*KEYS, "part")).applyInArrow(search, schema)


def best(scores: np.ndarray, k: int):
    """(anchor, row) of each anchor's k best scores; rows are in the order of their ids, NONE is no score."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        kth = np.full(len(scores), NONE)
    for i in range(len(scores)):
        at = np.flatnonzero((scores[i] >= kth[i]) & (scores[i] > NONE))
        yield i, at[np.argsort(-scores[i][at], kind="stable")[:k]]


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("vec_id", "ascending")])  # nulls are last


def _same(anchors: pa.Table, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
    return (np.asarray(anchors["vec_id"])[:, None] == ids) & ~no_id


def _dim(*tables: pa.Table) -> int:
    return max(1, *(pa.compute.max(pa.compute.list_value_length(t["v"])).as_py() or 0 for t in tables))


def band(score: int) -> tuple[int, int]:
    """The least and the greatest score of a negative; the first is above the second if there is none."""
    return -(-LOW * score // 100), HIGH * score // 100


def positives(anchors: DataFrame, rows: DataFrame, where: Space) -> DataFrame:
    """(row_, found): each anchor's best rows of its label, as (score, vec_id) from the best on."""

    def bounds(s: Space, x: np.ndarray, batch) -> tuple[np.ndarray, np.ndarray]:
        scores = products(x, s.sample)
        scores[_same(batch, s.ids, s.no_id) | (np.asarray(batch["label"])[:, None] != s.labels)] = NONE
        kth = np.sort(scores, axis=1)[:, -POSITIVES] if scores.shape[1] >= POSITIVES else np.full(len(x), NONE)
        return np.where(kth == NONE, -np.inf, kth.astype(float)), np.full(len(x), np.inf)

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            rows, dim = _in_order(rows), _dim(anchors, rows)
            ids, no_id = numbers(rows["vec_id"].combine_chunks())
            scores = products(matrix(anchors["v"], dim), matrix(rows["v"], dim))
            scores[_same(anchors, ids, no_id)] = NONE
            own = anchors["row_"].to_pylist()
            for i, at in best(scores, POSITIVES):
                out += ((own[i], s, None if n else v) for s, v, n in zip(scores[i][at].tolist(), ids[at].tolist(), no_id[at].tolist(), strict=True))
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], ["row_", "score", "vec_id"])

    groups = stored(grouped(anchors, True))
    found = met(groups, rows, needed(groups, where, bounds), True, search, "row_ long, score long, vec_id long")
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    first = found.withColumn("k_", F.row_number().over(Window.partitionBy("row_").orderBy(*order))).where(F.col("k_") <= POSITIVES)
    return first.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("k_", "score", "vec_id"))).alias("found"))


def negatives(anchors: DataFrame, rows: DataFrame, where: Space) -> DataFrame:
    """(row_, k_, positive_id, positive_score, negative_id, negative_score, rank) of anchors with their positives in found."""

    def bounds(s: Space, x: np.ndarray, batch) -> tuple[np.ndarray, np.ndarray]:
        scores = products(x, s.sample)
        scores[_same(batch, s.ids, s.no_id) | (np.asarray(batch["label"])[:, None] == s.labels)] = NONE
        least, most = np.full(len(x), np.inf), np.full(len(x), -np.inf)
        for i, found in enumerate(batch.column("found").to_pylist()):
            for low, high in (band(f["score"]) for f in found):
                if low <= high:
                    inside = np.sort(scores[i][(scores[i] >= low) & (scores[i] <= high)])
                    least[i] = min(least[i], inside[-NEGATIVES] if len(inside) >= NEGATIVES else low)
                    most[i] = max(most[i], high)
        return least, most

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            rows, dim = _in_order(rows), _dim(anchors, rows)
            ids, no_id = numbers(rows["vec_id"].combine_chunks())
            scores = products(matrix(anchors["v"], dim), matrix(rows["v"], dim))
            scores[_same(anchors, ids, no_id) | (np.asarray(anchors["label"])[:, None] == np.asarray(rows["label"]))] = NONE
            own, found = anchors["row_"].to_pylist(), anchors["found"].to_pylist()
            for k in range(max(map(len, found), default=0)):
                have = np.array([i for i, f in enumerate(found) if len(f) > k], np.int64)
                ends = np.array([band(found[i][k]["score"]) for i in have.tolist()], np.int64)
                inside = np.where((scores[have] >= ends[:, :1]) & (scores[have] <= ends[:, 1:]), scores[have], NONE)
                for j, at in best(inside, NEGATIVES):
                    f = found[have[j]][k]
                    out += ((own[have[j]], f["k_"], f["vec_id"], f["score"], None if n else v, s) for s, v, n in zip(inside[j][at].tolist(), ids[at].tolist(), no_id[at].tolist(), strict=True))
        names = ["row_", "k_", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 6)], names)

    groups = stored(grouped(anchors, False))
    schema = "row_ long, k_ long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = met(groups, rows, needed(groups, where, bounds), False, search, schema)
    order = Window.partitionBy("row_", "k_").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, anchor: Column) -> DataFrame:
    """Negatives for each anchor and positive, of rows (vec_id, label, v) with whole vectors (see whole). anchor: the condition of being
    one."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    where = space(rows)
    if where is None:
        return df.sparkSession.createDataFrame([], RESULT)
    rows = placed(rows, where)
    ends = rows.groupBy("cell", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).collect()  # PIVOTS * RINGS at most
    where.low, where.high = np.full((len(where.pivots), RINGS), np.inf), np.full((len(where.pivots), RINGS), -np.inf)
    for r in ends:
        where.low[r["cell"], r["ring"]], where.high[r["cell"], r["ring"]] = r["low"], r["high"]
    anchors = stored(rows.where(F.col("anchor") & F.col("vec_id").isNotNull()).select("vec_id", "label", "v", "cell", "row_").dropDuplicates(["vec_id", "label", "v"]))
    with_positives = stored(anchors.join(positives(anchors, rows, where), "row_"))
    found = negatives(with_positives, rows, where).join(anchors.select("row_", F.col("vec_id").alias("anchor_id")), "row_")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; a label is moved on by one where vec_id is divisible by 7."""
    rows = whole(apart(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows.select("vec_id", moved.alias("label"), F.col("embedding").alias("v")), F.col("vec_id") % 100 == 0)


ORACLE = f"""
with rows as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as materialized (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from (select distinct * from rows where vec_id % 100 = 0) a join rows b on b.vec_id is distinct from a.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as k
  from scores where same qualify k <= {POSITIVES}
), found as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.k order by s.score desc, s.vec_id) as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and {LOW} * p.positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * p.positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from found where rank <= {NEGATIVES}
"""
