"""Exact top-k inner products over norm-sorted vectors.

Candidates are cut into chunks by descending length. All vectors are rotated by
the eigenvectors of the Gram matrix (the right singular vectors of the data),
which moves most of every product into the leading coordinates. For a block of
queries and a chunk, the product over the leading coordinates plus the product
of the residual lengths bounds each score from above (Cauchy-Schwarz); only
candidates whose bound reaches the query's k-th best score so far get their
exact integer score. Whole chunks fall out through length times length.

Defined cases: a vector that is null, or holds a null or non-finite component,
takes no part; missing trailing components are zero; every candidate row counts,
repeated or not, but those with the query's own id; a query id that repeats
is answered once, for its smallest vector; ties go to the smaller id; null ids take
no part; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read_table

QUERY_BLOCK = 512
CHUNK_ROWS = 8192
#: Chunks are made larger rather than more than this, so that their lengths, the one list held on the driver, stay bounded.
MOST_CHUNKS = 16_384
LEADING = 16
#: Bytes of the longest vectors that every worker gets.
SEED_BYTES = 4 << 20
#: Tasks that the work of one chunk is spread over, at most.
GROUPS = 256


def integer_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, embedding) -> vec_id, v: floor(scale * x) as longs, valid vectors only."""
    scaled = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = F.expr("embedding is not null and vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    return df.where(fine).select(F.col("vec_id").cast("long"), scaled.alias("v"))


def _dense(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(-1, dim)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T; float64 arithmetic where it is exact, which is the fast way."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def search_chunk(q_ids, q, q_floor, c_ids, c, turn, k):
    """Best k of one chunk for each query: (query position, id, score) arrays. q_floor: scores below it can't matter."""
    lead = min(LEADING, q.shape[1])
    qr, cr = q @ turn, c @ turn
    q_rest, c_rest = (np.sqrt(np.maximum((x[:, lead:] ** 2).sum(1), 0)) for x in (qr, cr))
    q_len, c_len = (np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (q, c))
    floor = q_floor.astype(np.float64).copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids]
    for at in range(0, len(c), 1024):
        part = slice(at, at + 1024)
        slack = 1e-6 * (1 + q_len[:, None] * c_len[None, part])
        alive = np.flatnonzero(q_len * c_len[part].max() * (1 + 1e-9) + 1e-6 >= floor)
        if not len(alive):
            break  # lengths only fall from here on
        bound = qr[alive][:, :lead] @ cr[part][:, :lead].T + q_rest[alive, None] * c_rest[None, part] + slack[alive]
        near = (bound >= floor[alive, None]) & (q_ids[alive, None] != c_ids[None, part])
        columns = np.flatnonzero(near.any(0))
        if not len(columns):
            continue
        scores = exact_scores(q[alive], c[part][columns])
        for row, i in enumerate(alive):
            hit = columns[near[row, columns]]
            if not len(hit):
                continue
            got = scores[row][near[row, columns]]
            ids, all_scores = np.concatenate([best[i][0], c_ids[part][hit]]), np.concatenate([best[i][1], got])
            first = np.lexsort((ids, -all_scores))[:k]
            best[i] = ids[first], all_scores[first]
            if len(first) == k:
                floor[i] = max(floor[i], all_scores[first[-1]])
    return best


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Both (vec_id, v) of `integer_vectors`. Returns query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    schema = "query_id long, vec_id long, score long"
    found = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dim = found["n"], found["d"] or 0
    of_queries = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    asked, dim = of_queries["n"], max(dim, of_queries["d"] or 0)
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = max(CHUNK_ROWS, -(-n // MOST_CHUNKS))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _dense(b["v"], dim).astype(np.float64)
            total += x.T @ x
        yield pd.DataFrame({"i": range(dim), "row": list(total)})

    total = np.zeros((dim, dim))
    for i, row in candidates.mapInPandas(gram, "i int, row array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(dim)]).alias("row")).collect():
        total[i] = row
    turn = np.linalg.eigh(total)[1][:, ::-1].copy()

    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("length")

    def pack(size: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            base, made, held = TaskContext.get().partitionId() << 24, 0, []

            def out(full: pd.DataFrame) -> pd.DataFrame:
                v = _dense(full["v"], dim)
                return pd.DataFrame({"pack": [base + made], "ids": [full["vec_id"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()], "longest": [float(np.sqrt(full["length"].max()))]})

            for b in batches:
                held.append(b)
                while sum(map(len, held)) >= size:
                    whole = pd.concat(held, ignore_index=True)
                    yield out(whole[:size])
                    made, held = made + 1, [whole[size:]]
            whole = pd.concat(held, ignore_index=True) if held else []
            if len(whole):
                yield out(whole)

        return run

    packed = "pack long, ids binary, v binary, longest double"
    parts = max(1, n // (rows * 4))
    ordered = candidates.select("vec_id", "v", length).repartitionByRange(parts, F.desc("length"), "vec_id").coalesce(parts).sortWithinPartitions(F.desc("length"), "vec_id")
    chunks = cut(ordered.mapInPandas(pack(rows), packed))
    longest = sorted(((r["longest"], r["pack"]) for r in chunks.select("pack", "longest").collect()), reverse=True)  # MOST_CHUNKS at most, and one more a partition
    lengths = np.array([x for x, _ in longest])
    single = queries.groupBy("vec_id").agg(F.min("v").alias("v")).coalesce(max(1, asked // (QUERY_BLOCK * 4)))  # else blocks would be as small as partitions
    blocks = cut(single.select("vec_id", "v", length).mapInPandas(pack(QUERY_BLOCK), packed).withColumnRenamed("pack", "block"))

    # the longest vectors, SEED_BYTES of them at most, go to every worker: the k-th best score among them is a query's floor
    held = max(k + 1, min(rows, SEED_BYTES // (8 * dim)))
    first = chunks.where(F.col("pack") == longest[0][1]).select(F.substring("ids", 1, 8 * held).alias("ids"), F.substring("v", 1, 8 * dim * held).alias("v")).first()
    seed_ids, seeds = np.frombuffer(first["ids"], np.int64), _unpack(bytes(first["v"]), dim)

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block with its floors, and how many of the chunks, the longest first, may hold something for one of its queries."""
        for b in batches:
            for block, q_ids, q in zip(b["block"], b["ids"], b["v"]):
                ids, rows_ = np.frombuffer(q_ids, np.int64), _unpack(q, dim)
                best = search_chunk(ids, rows_, np.full(len(ids), -np.inf), seed_ids, seeds, turn, k)
                floor = np.array([s[-1] if len(s) == k else -np.inf for _, s in best], dtype=np.float64)
                size = np.sqrt((rows_.astype(np.float64) ** 2).sum(1))
                reach = (size[:, None] * lengths[None, :] * (1 + 1e-9) + 1e-6 >= floor[:, None]).any(0)
                yield pd.DataFrame({"block": [block], "q_ids": [q_ids], "q": [q], "floor": [floor.tobytes()], "upto": [int(reach.sum())]})

    aimed = cut(blocks.mapInPandas(aim, "block long, q_ids binary, q binary, floor binary, upto int"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_ids, q, floor, c_ids, c in zip(b["q_ids"], b["q"], b["floor"], b["ids"], b["v"]):
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                best = search_chunk(q_ids, _unpack(q, dim), np.frombuffer(floor, np.float64), c_ids, _unpack(c, dim), turn, k)
                yield pd.DataFrame({
                    "query_id": np.repeat(q_ids, [len(x) for x, _ in best]),
                    "vec_id": np.concatenate([x for x, _ in best]) if best else [],
                    "score": np.concatenate([s for _, s in best]) if best else [],
                })

    # a chunk meets blocks group by group, so that the longest ones, which every block needs, are spread over up to GROUPS tasks
    group = F.pmod(F.xxhash64("block"), F.lit(max(1, min(GROUPS, asked // QUERY_BLOCK)))).cast("int").alias("group")
    needs = aimed.select(group, "upto").groupBy("group").agg(F.max("upto").alias("upto")).collect()  # GROUPS at most
    place = spark.createDataFrame([(p, i) for i, (_, p) in enumerate(longest)], "pack long, place int")  # a row a chunk
    wanting = F.array(*[F.struct(F.lit(r["group"]).alias("group"), F.lit(r["upto"]).alias("upto")) for r in needs])
    copies = chunks.join(F.broadcast(place), "pack").select("place", "ids", "v", F.explode(F.transform(F.filter(wanting, lambda w: w["upto"] > F.col("place")), lambda w: w["group"])).alias("group"))
    asking = aimed.where("upto > 0").select("q_ids", "q", "floor", group, F.explode(F.expr("sequence(0, upto - 1)")).alias("place"))
    found = asking.join(copies.hint("merge"), ["place", "group"]).select("q_ids", "q", "floor", "ids", "v").mapInPandas(search, schema)
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id vec_id, cast(list_dot_product(q.e, c.e) as bigint) score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 5
"""
