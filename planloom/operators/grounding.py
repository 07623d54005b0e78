"""Claims judged against evidence, and the scores that follow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.citations import normalize
from planloom.operators import windows
from planloom.session import discard, stored

ACCEPT, REVIEW = 0.9, 0.7


def namespaced(claims: DataFrame, tasks: DataFrame) -> DataFrame:
    """Claim ids made unique in their project by the ordinal of their task."""
    numbered = windows.row_number(
        tasks.select("project_id", "task_id", "ord"), ["project_id"], windows.by_width(F.col("ord"), 10_000),
        [F.col("ord")], "ordinal",
    ).drop("ord")
    return claims.join(numbered, ["project_id", "task_id"]).withColumn(
        "claim_key", F.concat(F.lit("T"), F.col("ordinal").cast("string"), F.lit("-"), F.col("claim_id"))
    )


def unknown_task_claims(claims: DataFrame, tasks: DataFrame) -> DataFrame:
    return claims.join(tasks.select("project_id", "task_id"), ["project_id", "task_id"], "left_anti")


def latest_chunks(chunks: DataFrame, version: str) -> DataFrame:
    """Upsert by key: the newest row of each chunk."""
    rest = [c for c in chunks.columns if c not in ("project_id", "chunk_key")]
    return chunks.groupBy("project_id", "chunk_key").agg(F.max_by(F.struct(*rest), version).alias("_new")).select(
        "project_id", "chunk_key", "_new.*")


def verdicts(claims: DataFrame, judgements: DataFrame, chunks: DataFrame) -> DataFrame:
    """One verdict per claim: the last judgement, unsupported when there is none or nothing backs it."""
    keys = ["project_id", "task_id", "claim_id"]
    last = judgements.groupBy(*keys).agg(F.max_by(F.struct("verdict", "raw_key", "reasoning"), "pos").alias("j"))
    judged = claims.join(last, keys, "left").withColumn("chunk_key", normalize(F.col("j.raw_key")))
    known = chunks.select("project_id", "chunk_key", F.lit(True).alias("_known"))
    looked_up = judged.join(known, ["project_id", "chunk_key"], "left")
    bare = (F.col("j.verdict") == "supported") & F.col("_known").isNull()
    return looked_up.select(
        *claims.columns,
        F.when(F.col("j").isNull() | bare, "unsupported").otherwise(F.col("j.verdict")).alias("verdict"),
        F.when(F.col("j").isNull(), "The verifier did not return a judgement for this claim.")
        .when(bare, F.concat(F.lit("Marked supported but cited no evidence that exists in the SOW. "), F.col("j.reasoning")))
        .otherwise(F.col("j.reasoning")).alias("reasoning"),
        F.when(F.col("_known"), F.col("chunk_key")).otherwise("").alias("supporting_key"),
    )


def score_status(score: Column, contradicted: Column) -> Column:
    return F.when(contradicted, "reject").when(score >= ACCEPT, "accept").when(score >= REVIEW, "review").otherwise("reject")


def task_scores(tasks: DataFrame, judged: DataFrame) -> DataFrame:
    """Supported over total; a task that asserts nothing scores 1. One contradiction rejects."""
    counts = judged.groupBy("project_id", "task_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") == "supported").alias("supported"),
        F.bool_or(F.col("verdict") == "contradicted").alias("contradicted"),
    )
    joined = tasks.select("project_id", "task_id").join(counts, ["project_id", "task_id"], "left")
    score = F.coalesce(F.col("supported") / F.col("claims"), F.lit(1.0))
    return joined.select(
        "project_id", "task_id", F.coalesce("claims", F.lit(0)).alias("claims"), score.alias("score"),
        score_status(score, F.coalesce("contradicted", F.lit(False))).alias("status"),
    )


def project_scores(projects: DataFrame, judged: DataFrame) -> DataFrame:
    """Pooled over claims, not the mean of task scores."""
    pooled = judged.groupBy("project_id").agg(
        (F.count_if(F.col("verdict") == "supported") / F.count(F.lit(1))).alias("pooled"))
    return projects.select("project_id").join(pooled, "project_id", "left").select(
        "project_id", F.coalesce("pooled", F.lit(1.0)).alias("score"))


def by_team(judged: DataFrame, tasks: DataFrame) -> DataFrame:
    joined = judged.join(tasks.select("project_id", "task_id", "team"), ["project_id", "task_id"], "left")
    return joined.groupBy("project_id", F.coalesce("team", F.lit("unknown")).alias("team")).agg(
        (F.count_if(F.col("verdict") == "supported") / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("claims"))


def failures(judged: DataFrame, tasks: DataFrame) -> DataFrame:
    known = tasks.select("project_id", "task_id", "title", "team")
    return judged.filter(F.col("verdict") != "supported").join(known, ["project_id", "task_id"], "left").select(
        "project_id", "task_id", "claim_id", "text", "verdict", "is_quantitative",
        F.coalesce("title", F.lit("")).alias("task"), F.coalesce("team", F.lit("")).alias("team"))


def evidence_union(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited chunks first, then retrieved ones not already there; each once per task."""
    both = cited.select("project_id", "task_id", "chunk_key", F.lit(1).alias("priority")).union(
        retrieved.select("project_id", "task_id", "chunk_key", F.lit(2).alias("priority")))
    return both.groupBy("project_id", "task_id", "chunk_key").agg(F.min("priority").alias("priority"))


def evidence_line() -> Column:
    place = F.concat(F.col("section_title"), F.when(
        F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(""))
    return F.concat(F.lit("["), F.col("chunk_key"), F.lit("] ("), place, F.lit(")\n"), F.col("text"))


def rollup(tasks: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores and statuses copied onto the tasks that were graded; others keep theirs."""
    new = scored.select("project_id", "task_id", F.col("score").alias("_score"), F.col("status").alias("_status"))
    return tasks.join(new, ["project_id", "task_id"], "left").withColumn(
        "grounding_score", F.coalesce("_score", "grounding_score")
    ).withColumn("validation_status", F.coalesce("_status", "validation_status")).drop("_score", "_status")


#: Pivots of a project, and rings of distance around each that its vectors are parted into.
PIVOTS, RINGS = 16, 8
#: Distances are compared to six places: bounds are taken wider by a unit of the last, twice.
CLOSE = 2e-6
#: Vectors of a block: one is sent once for every block it meets, so fewer, larger blocks move less. Queries of
#: a pair of blocks whose distances are held at a time.
BLOCK, ROWS = 4096, 512


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _dealt(df: DataFrame, key: str, block: int, keys: list[str], name: str) -> DataFrame:
    """`name`: a number that deals the rows of each group out to shares of about `block`, by hash."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_shares"))
    return df.join(stored(counts), keys).withColumn(name, F.pmod(F.xxhash64(key), F.col("_shares")).cast("int")).drop("_shares")


def _parted(vectors: DataFrame, pivots: DataFrame, key: str, block: int) -> DataFrame:
    """Vectors with their distances to the project's pivots (`far`) and the block they are in: the nearest
    pivot (cell), the ring around it, and a share of what is in that ring. A project has about as many
    cells and rings as its corpus fills blocks."""
    dealt = _dealt(vectors, key, block, ["project_id"], "_deal")
    places = dealt.select("project_id", "_deal").distinct()
    sent = places.join(pivots, "project_id").select(F.col("project_id").alias("_of"), F.col("_deal").alias("_to"), "pivot", "blocks")

    def measure(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        columns = ["project_id", key, "vector", "far", "cell", "ring"]
        if rows.empty or given.empty:
            return pd.DataFrame(columns=columns)
        x, p = _unit(rows["vector"]), _unit(given["pivot"].sort_values(key=lambda c: c.map(tuple)))
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ p.T))
        blocks = int(given["blocks"].iloc[0])
        cells = min(len(p), blocks)
        rings = min(RINGS, -(-blocks // cells))
        cell = far[:, :cells].argmin(axis=1)
        near = far[np.arange(len(x)), cell]
        return pd.DataFrame({
            "project_id": rows["project_id"], key: rows[key], "vector": list(x), "far": list(far), "cell": cell.astype(np.int32),
            "ring": np.minimum(rings - 1, near * rings / 2**0.5).astype(np.int32),
        })[columns]

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"project_id {kinds['project_id']}, {key} {kinds[key]}, vector array<double>, far array<double>, cell int, ring int"
    # A group holds a share of a project, about `block` vectors, and the pivots, sixteen at most.
    measured = stored(dealt.groupBy("project_id", "_deal").cogroup(sent.groupBy("_of", "_to")).applyInPandas(measure, schema))
    parted = stored(_dealt(measured, key, block, ["project_id", "cell", "ring"], "part"))
    discard(measured)
    return parted


def _block_table(parted: DataFrame, name: str) -> DataFrame:
    """Blocks with their size and the least and greatest distance of their vectors to each pivot."""
    # A project with fewer pivots has nulls in the places of the others.
    bounds = [f(F.get("far", F.lit(k))) for k in range(PIVOTS) for f in (F.min, F.max)]
    return parted.groupBy("project_id", "cell", "ring", "part").agg(
        F.count(F.lit(1)).alias(f"{name}_n"), F.array(*bounds[::2]).alias(f"{name}_least"), F.array(*bounds[1::2]).alias(f"{name}_most")
    ).select("project_id", F.struct("cell", "ring", "part").alias(f"{name}_block"), f"{name}_n", f"{name}_least", f"{name}_most")


def _closest(k: int, key_kinds: dict[str, str]):
    """The k best of each query in a pair of blocks, where a pivot does not rule the query out."""
    columns = ["project_id", "query_id", "chunk_id", "distance"]

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=columns)
        far, within = np.stack(c["far"].to_numpy()), np.stack(q["far"].to_numpy())
        gap = np.maximum(far.min(axis=0) - within, within - far.max(axis=0)).max(axis=1)
        q = q[gap <= q["reach"].to_numpy()]
        if q.empty:
            return pd.DataFrame(columns=columns)
        a, b = np.stack(q["vector"].to_numpy()), np.stack(c["vector"].to_numpy())
        ids = c["chunk_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        nearby, far_off = [], []
        for at in range(0, len(a), ROWS):
            distance = np.round(1.0 - a[at:at + ROWS] @ b.T, 6)
            # Ties go to the lower id: sort by id first, then stably by distance.
            order = by_id[np.argsort(distance[:, by_id], axis=1, kind="stable")[:, :k]]
            nearby.append(order)
            far_off.append(np.take_along_axis(distance, order, axis=1))
        order = np.concatenate(nearby)
        return pd.DataFrame({
            "project_id": q["project_id"].iloc[0], "query_id": np.repeat(q["query_id"].to_numpy(), order.shape[1]),
            "chunk_id": ids[order.ravel()], "distance": np.concatenate(far_off).ravel(),
        })[columns]

    schema = f"project_id {key_kinds['project_id']}, query_id {key_kinds['query_id']}, chunk_id {key_kinds['chunk_id']}, distance double"
    return best, schema


def nearest(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK, told: list | None = None) -> DataFrame:
    """The k nearest corpus vectors per query within each project, exact, by cosine distance.

    queries(project_id, query_id, vector), corpus(project_id, chunk_id, vector). The distance of unit
    vectors obeys the triangle inequality, so the difference of two vectors' distances to a pivot bounds
    their own from below. Sixteen corpus vectors of each project are its pivots; vectors are parted by
    their nearest pivot and rings around it into blocks of about `block`. Each query first meets
    the blocks of its own cell and ring; the k-th best distance found there is its reach. Of all
    other block pairs only those meet whose bounds to every pivot lie within the reach of a query, and in
    them only such queries are compared. Nothing is lost, distances are compared as rounded.

    A project of any size is many small matrix products spread over the cluster. How much the pivots
    spare depends on the vectors: clusters are ruled out whole, evenly spread ones hardly.

    told: gets (pairs of vectors in block pairs that met, all pairs).
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *corpus.schema]}
    best, schema = _closest(k, kinds)
    pivots = windows.first_k(
        corpus.select("project_id", F.col("vector").alias("pivot"), F.xxhash64("chunk_id").alias("_h")), ["project_id"], [F.col("_h"), F.col("pivot")], PIVOTS, "_rank"
    ).select("project_id", "pivot")
    blocks = corpus.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    pivots = stored(pivots.join(blocks, "project_id"))
    left, right = _parted(queries, pivots, "query_id", block), _parted(corpus, pivots, "chunk_id", block)
    left_blocks, right_blocks = stored(_block_table(left, "q")), stored(_block_table(right, "c"))

    def met(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """pairs(project_id, q_block, c_block) of blocks, compared in one task each."""
        q = pairs.join(asking, ["project_id", "q_block"])
        c = pairs.join(right.withColumn("c_block", F.struct("cell", "ring", "part")), ["project_id", "c_block"]).select(
            F.col("project_id").alias("of_project"), F.col("q_block").alias("of_q"), F.col("c_block").alias("of_c"), "chunk_id", "vector", "far")
        return q.select("project_id", "q_block", "c_block", "query_id", "vector", "far", "reach").groupBy("project_id", "q_block", "c_block").cogroup(
            c.groupBy("of_project", "of_q", "of_c")).applyInPandas(best, schema)

    asking = left.withColumn("q_block", F.struct("cell", "ring", "part")).select("project_id", "q_block", "query_id", "vector", "far")
    pairs = left_blocks.join(right_blocks, "project_id")
    own = (F.col("q_block.cell") == F.col("c_block.cell")) & (F.col("q_block.ring") == F.col("c_block.ring"))
    first = stored(met(pairs.filter(own).select("project_id", "q_block", "c_block"), asking.withColumn("reach", F.lit(4.0))))
    found = windows.first_k(first, ["project_id", "query_id"], [F.col("distance"), F.col("chunk_id")], k, "rank")
    # With fewer than k found the reach is that of all unit vectors.
    reaches = found.groupBy("project_id", "query_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d")).select(
        "project_id", "query_id", F.when(F.col("_n") < k, 4.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("_d") + CLOSE))) + CLOSE).alias("reach"))
    asking = stored(asking.join(reaches, ["project_id", "query_id"], "left").na.fill({"reach": 4.0}))
    furthest = asking.groupBy("project_id", "q_block").agg(F.max("reach").alias("reach"))
    gap = F.array_max(F.zip_with(
        F.zip_with("q_least", "c_most", lambda a, b: a - b), F.zip_with("c_least", "q_most", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    other = stored(pairs.filter(~own).join(furthest, ["project_id", "q_block"]).filter(F.coalesce(gap, F.lit(0.0)) <= F.col("reach")).select(
        "project_id", "q_block", "c_block", (F.col("q_n") * F.col("c_n")).alias("n")))
    if told is not None:
        counted = [x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (
            other, pairs.filter(own).select((F.col("q_n") * F.col("c_n")).alias("n")), pairs.select((F.col("q_n") * F.col("c_n")).alias("n")))]
        told.append((counted[0] + counted[1], counted[2]))
    candidates = first.unionByName(met(other.drop("n"), asking))
    return windows.first_k(candidates, ["project_id", "query_id"], [F.col("distance"), F.col("chunk_id")], k, "rank")
