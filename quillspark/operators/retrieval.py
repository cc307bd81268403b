"""Nearest chunks for a table of queries: exact search, bound, diversity, context, metrics."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P


def meet(few: DataFrame, many: DataFrame, key: str, *conditions: Column, ways: int | None = None) -> DataFrame:
    """Each row of ``few`` beside each row of ``many`` (that satisfies the conditions).

    Rows of ``many`` are dealt to ``ways`` keys by hash of ``key``, and ``few`` is copied to each, so that no key of the
    conditions is hot. Nothing is broadcast by name: the join's kind is Spark's choice, by measured sizes.
    """
    ways = ways or int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = few.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    dealt = many.withColumn("_way", F.pmod(F.xxhash64(key), F.lit(ways)).cast("int"))
    both = copies.join(dealt, "_way").drop("_way")
    for condition in conditions:
        both = both.where(condition)
    return both


def distances(queries: DataFrame, store: DataFrame, *, block: int = 256, ways: int | None = None) -> DataFrame:
    """query_id, id, distance of each query (query_id, embedding) and each row of ``store`` (id, embedding).

    Cosine distances rounded to 6 digits; null where a vector is missing or holds a null, 1 where one is zero, null where
    dimensions differ. Blocks of both sides meet as in ``knn_search``; a task gives the pairs of two blocks at a time, so its memory
    grows with neither side. The pairs grow with their product.
    """
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(store.dtypes)["id"]}
    asked = _packed_by_dimension(queries.select(F.col("query_id").alias("id"), "embedding"), kinds["query_id"], block)
    asked = asked.withColumnsRenamed({"number": "q_number", "ids": "q_ids", "vectors": "q_vectors"})
    blocks = meet(asked, _packed_by_dimension(store.select("id", "embedding"), kinds["id"], block), "number", ways=ways)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_raw, ids, raw in zip(*(batch.column(c) for c in ("q_ids", "q_vectors", "ids", "vectors")), strict=True):
                q_ids, ids, distance = q_ids.values, ids.values, None
                n = len(q_ids) * len(ids)
                if q_raw.is_valid and raw.is_valid:
                    (matrix, lengths), (vectors, own) = _unpacked(q_raw.as_py(), len(q_ids)), _unpacked(raw.as_py(), len(ids))
                    scale, alike = lengths[:, None] * own[None, :], matrix.shape[1] == vectors.shape[1]
                    cosine = np.divide(matrix @ vectors.T if alike else 0.0, scale, out=np.zeros_like(scale), where=scale != 0)
                    distance = pa.array((np.floor((1 - cosine) * 1e6 + 0.5) / 1e6).ravel(), mask=None if alike else (scale != 0).ravel())
                query, other = np.repeat(np.arange(len(q_ids)), len(ids)), np.tile(np.arange(len(ids)), len(q_ids))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(query)), ids.take(pa.array(other)), pa.nulls(n, pa.float64()) if distance is None else distance], names=["query_id", "id", "distance"])

    return blocks.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(pairs, f"query_id {kinds['query_id']}, id {kinds['id']}, distance double")


def knn_search(queries: DataFrame, store: DataFrame, k: int, *, exclude_self: bool = False, block: int = 1_024, ways: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``store`` (id, embedding, ...) for each query (query_id, embedding): exact.

    Both sides are packed into blocks of at most ``block`` vectors, one row each. Blocks of the store are dealt to
    ``ways`` keys, blocks of queries copied to each, and a join lets them meet: one pass over the store, nothing through
    the driver. A task multiplies pairs of blocks and keeps the ``k`` best of a block of queries while that block lasts;
    what tasks keep is merged by query. Distances are rounded to 6 digits; ties go by id. ``exclude_self`` leaves out rows
    whose id is the query's; null vectors are left out.
    """
    kind = dict(store.dtypes)["id"]
    asked = _packed(queries.select(F.col("query_id").alias("id"), "embedding"), kind, block).withColumnsRenamed({"number": "q_number", "ids": "q_ids", "vectors": "q_vectors"})
    blocks = meet(asked, _packed(store.select("id", "embedding"), kind, block), "number", ways=ways)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best = None, None  # the block of queries in hand: number, ids; place in it, distance, id of the best so far

        def found() -> pd.DataFrame:
            return pd.DataFrame({"query_id": at[1][best[0]], "id": best[2], "distance": best[1]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if at is None or at[0] != row.q_number:
                    if at is not None:
                        yield found()
                    at, best = (row.q_number, np.asarray(row.q_ids, dtype=object)), (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object))
                    matrix, lengths = _unpacked(row.q_vectors, len(at[1]))
                ids = np.asarray(row.ids, dtype=object)
                vectors, own = _unpacked(row.vectors, len(ids))
                product, scale = matrix @ vectors.T, lengths[:, None] * own[None, :]
                distance = np.round(1 - np.divide(product, scale, out=np.zeros_like(product), where=scale > 0), 6)
                last = min(k, len(ids) - 1)  # one more than k, as the query itself may be left out
                query, place = np.nonzero(distance <= np.partition(distance, last, axis=1)[:, last, None])
                if exclude_self:
                    other = ids[place] != at[1][query]
                    query, place = query[other], place[other]
                best = _nearest(np.concatenate([best[0], query]), np.concatenate([best[1], distance[query, place]]), np.concatenate([best[2], ids[place]]), k)
        if at is not None:
            yield found()

    parts = blocks.mapInPandas(search, f"query_id {kind}, id {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(vectors: DataFrame, kind: str, block: int) -> DataFrame:
    """Blocks of at most ``block`` vectors (id, embedding): number, ids, and their numbers as doubles one after another."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), itertools.count()  # numbers that a task which runs again gives again
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            for first in range(0, len(batch), block):
                part = batch.iloc[first : first + block]
                yield pd.DataFrame({"number": [f"{task}-{next(n)}"], "ids": [part["id"].tolist()], "vectors": [np.stack(part["embedding"].to_numpy()).astype(np.float64).tobytes()]})

    return vectors.mapInPandas(pack, f"number string, ids array<{kind}>, vectors binary")


def _packed_by_dimension(vectors: DataFrame, kind: str, block: int) -> DataFrame:
    """As ``_packed``, of vectors of one dimension a block; a block of vectors that are missing or hold a null has none. Rows have ids."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            for dimension, rows in batch.groupby(batch["embedding"].map(lambda v: -1 if v is None else len(v))):
                for first in range(0, len(rows), block):
                    part = rows.iloc[first : first + block]
                    raw = None if dimension < 0 else np.stack(part["embedding"].to_numpy()).astype(np.float64).tobytes()
                    yield pd.DataFrame({"number": [f"{task}-{next(n)}"], "ids": [part["id"].tolist()], "vectors": [raw]})

    whole = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    return vectors.where("id is not null").select("id", whole.alias("embedding")).mapInPandas(pack, f"number string, ids array<{kind}>, vectors binary")


def _unpacked(raw: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a block and their lengths."""
    matrix = np.frombuffer(raw, dtype=np.float64).reshape(rows, -1)
    return matrix, np.sqrt((matrix * matrix).sum(axis=1))


def _nearest(query: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each query by distance, then id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], distance, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[place < k]
    return query[place < k], distance[order], ids[order]


def distance_filter(hits: DataFrame, bound: float | None) -> DataFrame:
    """Hits no farther than ``bound``, which counts as near; None keeps all."""
    return hits if bound is None else hits.where(F.col("distance") <= bound)


def diversity_rerank(hits: DataFrame, penalty: float = 0.05) -> DataFrame:
    """New ranks of hits (query_id, id, source_doc, distance, rank): the third and later of a source give way."""
    nth = F.row_number().over(Window.partitionBy("query_id", "source_doc").orderBy("rank"))
    ranked = hits.withColumn("_adjusted", F.round(F.col("distance") + F.greatest(F.lit(0), nth - 2) * penalty, 6))
    order = Window.partitionBy("query_id").orderBy("_adjusted", "rank")
    return ranked.withColumn("rank", F.row_number().over(order)).drop("_adjusted")


def retrieve(queries: DataFrame, store: DataFrame, *, k: int = 5, bound: float | None = 0.5, diversify: bool = True, exclude_self: bool = False) -> DataFrame:
    """Ranked hits of each query: twice ``k`` nearest, bound, diversity, first ``k``; with the store's other columns."""
    hits = knn_search(queries, store, 2 * k if diversify else k, exclude_self=exclude_self)
    hits = distance_filter(hits, bound).join(store.drop("embedding"), "id")
    if diversify:
        hits = diversity_rerank(hits)
    return hits.where(F.col("rank") <= k)


def construct_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and context: numbered blocks of its hits (source_doc, section, text); a fixed sentence without any."""
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("source_doc", F.lit("?")), F.lit(" / "), F.coalesce("section", F.lit("?")), F.lit("]\n"))
    blocks = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(head, "text").alias("block")))).alias("b"))  # at most k a query
    context = F.array_join(F.transform("b", lambda x: x["block"]), P.CONTEXT_SEPARATOR)
    return queries.select("query_id").join(blocks, "query_id", "left").select("query_id", F.coalesce(context, F.lit(P.NO_HITS)).alias("context"))


def retrieve_context(queries: DataFrame, store: DataFrame, **more) -> tuple[DataFrame, DataFrame]:
    """Contexts and hits of queries."""
    hits = retrieve(queries, store, **more)
    return construct_context(queries, hits), hits


def union_hits(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of two searches for one query, each id once at its least distance, ranked anew."""
    both = first.select("query_id", "id", "distance").unionByName(second.select("query_id", "id", "distance"))
    least = both.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return least.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))


def retrieval_metrics(hits: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Precision at ``k``, recall and F1 of each query, and the rank of its first relevant hit.

    ``relevance`` has a row (query_id, id) for each relevant pair.
    """
    found = hits.where(F.col("rank") <= k).join(relevance.withColumn("_yes", F.lit(1)), ["query_id", "id"], "left")
    per_query = found.groupBy("query_id").agg(F.count("_yes").alias("n_found"), F.min(F.when(F.col("_yes") == 1, F.col("rank"))).alias("first_rank"))
    relevant = relevance.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    joined = relevant.join(per_query, "query_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    precision, recall = F.col("n_found") / F.lit(k), F.col("n_found") / F.col("n_relevant")
    f1 = F.when(F.col("n_found") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return joined.select("query_id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), "first_rank")


def citation_check(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Each number that an answer (query_id, sources) cites, the hit (query_id, rank, id) it names, and whether there is one."""
    cited = answers.select("query_id", F.explode("sources").alias("cited"))
    joined = cited.join(hits.select("query_id", F.col("rank").alias("cited"), "id"), ["query_id", "cited"], "left")
    return joined.select("query_id", "cited", "id", F.col("id").isNotNull().alias("resolved"))
