"""Prefix trie of conversations by leaf-peeling message passing.

A node is a distinct sequence of first turns (role, text); its key is a hash chained over the turns' digests (128 bits of
SHA-256), so that texts don't move. Nodes with one set of members lie on one unbranched run of the trie and have one
smallest member and one count, by which they are brought together without iteration. Message passing is between runs:
each holds the number of children it still waits for; runs that wait for none are complete, send their subtree's totals
to their parents (a partial aggregate, so a parent of very many children is no hot task) and leave the table. Rounds
grow with the number of branchings on a path, not with the number of turns; each is written to the shared folder, and
only whether any run still waits reaches the driver.

Edge cases: rows with a null conv_id are left out; null role or text is empty; turns are ordered by turn, null first, and
those of equal turn by the digest of role and text; repeated rows are turns of their own; other columns are not read; an
empty table gives no rows, not even a root. One conversation's turns, and the ids that end at one node, pass through one
task as a stream (their hashes are sequential); neither is held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, store

ROOT = b""
#: Ids that agree but for so many low bits are joined before they go to the task that hashes them.
ID_BITS = 12


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, part (1), turn, digest, n (code points of the text) and skip (0) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("n"), F.lit(0).alias("skip"))


def share_first_turns(turns: DataFrame, *, group: int = 100, choices: int = 6) -> DataFrame:
    """Rebuild every conversation c: the first h turns of c - c % group, then c's own after its first h (h = crc32(c) % choices).

    Taken turns have part 0; ``skip`` is how many own turns fall away. At most ``group`` conversations share a first one,
    of which at most ``choices`` - 1 turns are kept.
    """

    def taken(c: Column) -> Column:
        return F.when(c % group == 0, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % choices).cast("int")

    first = turns.where(F.col("conv_id") % group == 0).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))).where(F.col("at") < choices)
    heads = first.select(F.col("conv_id").alias("base"), F.col("at").cast("long").alias("turn"), "digest", "n")
    convs = turns.select("conv_id").distinct().withColumn("h", taken(F.col("conv_id"))).where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    before = convs.join(heads, "base").where("turn <= h").select("conv_id", F.lit(0).alias("part"), "turn", "digest", "n", F.lit(0).alias("skip"))
    return turns.withColumn("skip", taken(F.col("conv_id"))).unionByName(before)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each conversation passes, from rows sorted by conversation, part and turn; ``ends`` marks the last."""
    conv, key, depth, left, last = None, ROOT, 0, 0, None
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.bool_())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        rows: list[tuple] = []
        for c, part, digest, n, skip in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "digest", "n", "skip")), strict=True):
            if c != conv:
                if last is not None:
                    rows.append((*last, True))
                conv, key, depth, left = c, ROOT, 0, None
                last = (ROOT, None, 0, 0, c)
            if part:
                left = skip if left is None else left
                if left:
                    left -= 1
                    continue
            rows.append((*last, False))
            parent, key = key, hashlib.sha256(key + digest).digest()[:16]
            depth += 1
            last = (key, parent, depth, n, c)
        if rows:
            yield made(rows)
    if last is not None:
        yield made([(*last, True)])


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's joined ids, from blocks sorted by key and block."""
    key, state, done = None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["run", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield made()
            done = []
    if state is not None:
        done.append((key, state.hexdigest()))
        yield made()


def peel(runs: DataFrame, *, max_rounds: int = 100_000) -> tuple[DataFrame, list[str]]:
    """Totals of each run (run, parent, own): n_children, n_leaves, beneath (what all runs under it own); and their folders.

    ``waits`` counts the children that haven't reported. Null parents are tops; rounds end when no run waits.
    """
    spark = runs.sparkSession
    kids = runs.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "run")
    start = runs.join(kids, "run", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    start = start.withColumns({"waits": F.col("n_children"), "n_leaves": (F.col("n_children") == 0).cast("long"), "beneath": F.lit(0).cast("long")})
    state, path = store(start, "trie-round")
    done, paths = [], [path]
    for _ in range(max_rounds):
        done.append(state.where("waits = 0").drop("waits"))
        rest = state.where("waits > 0")
        if rest.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out, paths
        sent = done[-1].where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("more_leaves"), F.sum(F.col("beneath") + F.col("own")).alias("more"))
        took = rest.join(sent.withColumnRenamed("parent", "run"), "run", "left")
        none = F.lit(0).cast("long")
        took = took.withColumns({"waits": F.col("waits") - F.coalesce("k", none), "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", none), "beneath": F.col("beneath") + F.coalesce("more", none)})
        state, path = store(took.drop("k", "more_leaves", "more"), "trie-round")
        paths.append(path)
    discard(spark, *paths)
    raise RuntimeError(f"runs still wait after {max_rounds} rounds")


def build_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "digest")
    passed, passed_at = store(ordered.mapInArrow(walk, "key binary, parent binary, depth long, n long, conv_id long, ends boolean"), "trie-passed")
    nodes = passed.groupBy("key", "parent", "depth", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    upwards = Window.partitionBy("conv_id", "n_convs").orderBy(F.col("depth").desc())
    so_far = upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed, _ = store(
        nodes.select(
            "conv_id", "depth", "n_convs",
            F.first("key").over(so_far).alias("run"),
            F.sum((F.col("n_convs") - 1) * F.col("n")).over(so_far).alias("below"),
            (F.row_number().over(upwards) == 1).alias("tail"),
            F.lead("key").over(upwards).isNull().alias("head"),
            "parent",
        ), "trie-nodes",
    )
    heads = placed.where("head").select("run", "parent", "conv_id", F.col("below").alias("own"))
    above = heads.select(F.col("run").alias("parent"), F.col("conv_id").alias("above_conv_id"))
    totals, rounds = peel(heads.join(above, "parent", "left"))
    blocks = passed.where("ends").groupBy(F.col("key").alias("run"), F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ends = blocks.repartition("run").sortWithinPartitions("run", "block").select("run", "ids").mapInArrow(hash_ids, "run binary, ends_sha256 string")
    known, _ = store(totals.join(ends, "run", "left").select("run", "above_conv_id", "own", "n_children", "n_leaves", "beneath", "ends_sha256"), "trie-runs")
    discard(spark, passed_at, *rounds)
    return placed.join(known, "run").select(
        "conv_id", "depth",
        F.when(F.col("head"), F.col("above_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("tail"), F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("below") + F.col("beneath")).alias("saved_tokens"),
        F.when(F.col("tail") & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
