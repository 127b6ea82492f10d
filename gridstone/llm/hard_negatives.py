"""Hard-negative mining: a two-dimensional block matrix multiply whose score tiles are added by shuffle.

Anchors and rows are cut into blocks, and vectors into chunks of dimensions. A task multiplies
one anchor block, one row block and one chunk to a partial int64 score tile; the tiles of a
block pair meet in a shuffle, are added, and give the few best rows of each anchor, which a
ranking over all blocks then narrows to the best of all. Blocks hold whole classes of labels:
the first multiply, for positives, is of blocks of one class only; the second, for negatives
within each positive's window, of all others (and of classes with more than one label). So no
score is computed twice and no tile is stored. Blocks, tiles and what a task emits are bounded
whatever the table holds; nothing but 32 class sizes reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.llm.common import materialize, table

#: Rows of a row block and of an anchor block (about; dealt by hash), and the least dimensions and the most chunks of a vector.
ROWS, ANCHORS, CHUNK, CHUNKS = 4096, 64, 32, 16
#: Labels are hashed into so many classes.
CLASSES = 32
#: Each 100th id is an anchor.
ANCHOR_STEP = 100
#: How many positives an anchor and how many negatives a positive has, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Components become floor(SCALE * x) and must stay below LARGEST.
SCALE, LARGEST = 256, 1 << 24

_BLOCK = "block long, class int, chunk int, ids array<long>, labels array<long>, rows array<long>, part binary"
_TILE = "ab long, rb long, a_ids array<long>, a_labels array<long>, a_rows array<long>, wanted array<struct<row:long,positive:long,number:int,score:long>>, b_ids array<long>, b_labels array<long>, b_rows array<long>, tile binary"
_WANTED = pa.list_(pa.struct([("row", pa.int64()), ("positive", pa.int64()), ("number", pa.int32()), ("score", pa.int64())]))
_PAIR = "row long, anchor_id long, number int, other_row long, other_id long, score long"


def usable(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, vector of the rows that take part: label, vector and all its components there and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def _integers(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """floor(SCALE * x) of each vector as int32, missing components 0."""
    values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(v) for v in vectors)])
    whole = np.floor(SCALE * values)
    if len(whole) and float(np.abs(whole).max()) >= LARGEST:
        raise ValueError(f"a component is {LARGEST // SCALE} or more in size: scores would not fit a long")
    out = np.zeros((len(ends) - 1, dims), dtype=np.int32)
    lengths = np.diff(ends)
    out[np.arange(dims)[None, :] < lengths[:, None]] = whole
    return out


def _blocks(rows: DataFrame, offsets: list[int], dims: int, width: int) -> DataFrame:
    """Stored blocks: class g has blocks offsets[g] to offsets[g + 1] - 1, to which its rows are dealt by a hash of their row number."""
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("class") + 1)
    many = F.element_at(F.array(*[F.lit(b - a).cast("long") for a, b in zip(offsets, offsets[1:])]), F.col("class") + 1)
    dealt = rows.withColumn("block", first + F.pmod(F.xxhash64("row"), many))

    def build(found: pa.Table) -> pa.Table:
        vectors = found.column("vector").combine_chunks()
        whole = _integers(vectors, dims)
        small = whole.astype(np.int16) if len(whole) and np.abs(whole).max() < 1 << 15 else whole
        heads = {c: pa.array([found.column(n).to_pylist()], pa.list_(pa.int64())) for c, n in (("ids", "vec_id"), ("labels", "label"), ("rows", "row"))}
        out = []
        for k, at in enumerate(range(0, dims, width)):
            part = np.ascontiguousarray(small[:, at : at + width])
            record = {"block": pa.array([found.column("block")[0].as_py()]), "class": pa.array([found.column("class")[0].as_py()], pa.int32()), "chunk": pa.array([k], pa.int32())}
            record |= heads if k == 0 else {c: pa.nulls(1, pa.list_(pa.int64())) for c in heads}
            out.append(pa.table(record | {"part": pa.array([bytes([part.dtype.itemsize]) + part.tobytes()], pa.binary())}))
        return pa.concat_tables(out)

    return dealt.groupBy("block").applyInArrow(build, _BLOCK)


def _matrix(part: bytes, width: int) -> np.ndarray:
    return np.frombuffer(part, dtype=np.int16 if part[0] == 2 else np.int32, offset=1).reshape(-1, width)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact in int64: by floating point where every sum fits 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _multiply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The partial tile of one anchor block, row block and chunk; the first chunk's carries what the rows are called."""
    schema = pa.schema([("ab", pa.int64()), ("rb", pa.int64()), *[(f"a_{c}", pa.list_(pa.int64())) for c in ("ids", "labels", "rows")], ("wanted", _WANTED), *[(f"b_{c}", pa.list_(pa.int64())) for c in ("ids", "labels", "rows")], ("tile", pa.binary())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    a, b = left.to_pylist()[0], right.to_pylist()[0]
    tile = product(_matrix(a["part"], a["width"]), _matrix(b["part"], b["width"]))
    record = {"ab": a["ab"], "rb": a["rb"], "wanted": a["wanted"], "tile": tile.tobytes()} | {f"a_{c}": a[c] for c in ("ids", "labels", "rows")} | {f"b_{c}": b[c] for c in ("ids", "labels", "rows")}
    return pa.Table.from_pylist([record], schema)


def _added(tiles: pa.Table) -> tuple[dict, np.ndarray]:
    """What the rows are called, and the whole score tile: the sum of the partial ones."""
    total, head = None, None
    for at in range(tiles.num_rows):
        raw = tiles.column("tile")[at].as_buffer()
        part = np.frombuffer(raw, dtype=np.int64)
        total = part.copy() if total is None else total + part
        if tiles.column("a_rows")[at].is_valid:
            head = tiles.slice(at, 1).drop_columns(["tile"]).to_pylist()[0]
    return head, total.reshape(len(head["a_rows"]), len(head["b_rows"]))


def _best(fits: np.ndarray, scores: np.ndarray, ids: np.ndarray, blank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of those that fit: by score from the highest, then by id, rows without an id last."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.lexsort((ids[at], blank[at], -scores[at]))][:k]


def _named(head: dict) -> tuple[np.ndarray, ...]:
    blank = np.array([x is None for x in head["b_ids"]])
    ids = np.array([0 if x is None else x for x in head["b_ids"]], dtype=np.int64)
    return ids, blank, np.array(head["b_labels"], dtype=np.int64), np.array(head["b_rows"], dtype=np.int64)


def _pairs(found: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*found)) or [[]] * 6
    return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(_PAIR.split(", "), columns, kinds)})


def _tile_positives(tiles: pa.Table) -> pa.Table:
    head, scores = _added(tiles)
    ids, blank, labels, rows = _named(head)
    found = []
    for i, (row, name, label) in enumerate(zip(head["a_rows"], head["a_ids"], head["a_labels"])):
        for at in _best((labels == label) & (rows != row), scores[i], ids, blank, POSITIVES):
            found.append((row, name, 0, int(rows[at]), head["b_ids"][at], int(scores[i, at])))
    return _pairs(found)


def _tile_negatives(tiles: pa.Table) -> pa.Table:
    head, scores = _added(tiles)
    ids, blank, labels, rows = _named(head)
    place = {row: i for i, row in enumerate(head["a_rows"])}
    found = []
    for want in head["wanted"] or ():
        i, p = place[want["row"]], want["score"]
        fits = (labels != head["a_labels"][i]) & (100 * scores[i] >= LOW * p) & (100 * scores[i] <= HIGH * p)
        for at in _best(fits, scores[i], ids, blank, NEGATIVES):
            found.append((want["row"], head["a_ids"][i], want["number"], int(rows[at]), head["b_ids"][at], int(scores[i, at])))
    return _pairs(found)


def _tiles(anchors: DataFrame, rows: DataFrame, partners: Column, anchor_partners: Column, width: int, tail: int, chunks: int) -> DataFrame:
    """Partial tiles of every anchor block with its row blocks: both are sent along the grid's rows and columns, a chunk at a time."""
    wide = F.when(F.col("chunk") == chunks - 1, tail).otherwise(width).alias("width")
    left = anchors.select(F.col("block").alias("ab"), F.explode(anchor_partners).alias("rb"), "chunk", "ids", "labels", "rows", "part", "wanted", wide)
    right = rows.select(F.explode(partners).alias("ab"), F.col("block").alias("rb"), "chunk", "ids", "labels", "rows", "part", wide)
    return left.groupBy("ab", "rb", "chunk").cogroup(right.groupBy("ab", "rb", "chunk")).applyInArrow(_multiply, _TILE)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the contract of op12.

    A row with a null label or vector, or with a null or non-finite component, takes no part; one
    with a null vec_id does, as the last among equal scores, but is no anchor. Repeated rows are
    rows of their own: a copy of an anchor is one of its positives, and each of two equal anchors
    has its own rows in the result. Vectors of unequal length multiply as if the shorter had zeros.
    A component of 2^16 or more in size raises an error, since scores might not fit a long. An empty
    table, one without anchors, and anchors without positives or negatives give no rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    kept = materialize(usable(embeddings).withColumn("class", F.pmod(F.xxhash64("label"), F.lit(CLASSES)).cast("int")), "vectors")
    anchor = F.col("vec_id") % ANCHOR_STEP == 0
    sizes = {r["class"]: r for r in kept.groupBy("class").agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), (F.min("label") == F.max("label")).alias("pure"), F.max(F.size("vector")).alias("dims")).collect()}
    dims = max((r["dims"] for r in sizes.values()), default=1) or 1
    if dims * 100 * LARGEST**2 >= 2**63:
        raise ValueError(f"vectors of {dims} components: scores might not fit a long")
    width = max(CHUNK, -(-dims // CHUNKS))
    chunks = max(1, -(-dims // width))
    tail = dims - (chunks - 1) * width

    def offsets(n: str, size: int) -> list[int]:
        return [0, *accumulate(-(-sizes[g][n] // size) if g in sizes else 0 for g in range(CLASSES))]

    a_from, r_from = offsets("anchors", ANCHORS), offsets("n", ROWS)
    if not a_from[-1]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = materialize(_blocks(kept, r_from, dims, width), "row-blocks")
    anchors = materialize(_blocks(kept.where(anchor), a_from, dims, width), "anchor-blocks")

    def own(edges: list[int]) -> Column:
        """The other side's blocks of the block's class."""
        at = lambda k: F.element_at(F.array(*[F.lit(x).cast("long") for x in edges]), F.col("class") + 1 + k)
        return F.when(at(1) > at(0), F.sequence(at(0), F.greatest(at(1) - 1, at(0)))).otherwise(F.array().cast("array<long>"))

    def others(edges: list[int]) -> Column:
        """All of the other side's blocks, without those of the block's class where that holds one label."""
        pure = F.element_at(F.array(*[F.lit(bool(g in sizes and sizes[g]["pure"])) for g in range(CLASSES)]), F.col("class") + 1)
        every = F.sequence(F.lit(0).cast("long"), F.lit(edges[-1] - 1).cast("long"))
        return F.when(pure, F.array_except(every, own(edges))).otherwise(every)

    bare = anchors.withColumn("wanted", F.lit(None).cast("array<struct<row:long,positive:long,number:int,score:long>>"))
    near = _tiles(bare, rows, own(a_from), own(r_from), width, tail, chunks).groupBy("ab", "rb").applyInArrow(_tile_positives, _PAIR)
    first = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_row")
    positives = materialize(near.withColumn("number", F.row_number().over(first)).where(F.col("number") <= POSITIVES), "positives")

    blocks = anchors.where("chunk = 0").select("block", F.explode("rows").alias("row"))
    wanted = positives.join(blocks, "row").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", F.col("other_row").alias("positive"), "number", "score"))).alias("wanted"))  # at most ANCHORS * POSITIVES a block, about
    asking = anchors.join(wanted, "block")  # anchors without positives want no negatives
    hard = _tiles(asking, rows, others(a_from), others(r_from), width, tail, chunks).groupBy("ab", "rb").applyInArrow(_tile_negatives, _PAIR)
    best = W.partitionBy("row", "number").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_row")
    ranked = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
    named = positives.select("row", "number", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["row", "number"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with k as (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.row as anchor, a.vec_id as anchor_id, a.label = b.label as same, b.row as other, b.vec_id as other_id, cast(list_dot_product(a.v, b.v) as bigint) as score
      from k a, k b where a.vec_id % {ANCHOR_STEP} = 0 and a.row <> b.row),
p as (select * from (select *, row_number() over (partition by anchor order by score desc, other_id, other) as n from s where same) where n <= {POSITIVES}),
h as (select p.anchor_id, p.other_id as positive_id, row_number() over (partition by p.anchor, p.n order by s.score desc, s.other_id, s.other) as rank,
             s.other_id as negative_id, p.score as positive_score, s.score as negative_score
      from p join s on p.anchor = s.anchor and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from h where rank <= {NEGATIVES}"""
