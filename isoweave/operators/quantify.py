"""Read assignment, expectation-maximization and expression tables (sections B, E, G and K of the survey)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, stored, write_through
from . import paths as path_ops
from .graph import connected_components


def equal_split(tracking: DataFrame) -> DataFrame:
    """K4: each read's weight shared equally among a gene's transcripts that it hits."""
    n = tracking.groupBy("gene_id", "read_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return tracking.join(n, ["gene_id", "read_id"]).withColumn("frac", 1.0 / F.col("n_hits"))


def end_weights(hits: DataFrame, *, pseudo: float = 50.0) -> DataFrame:
    """K2: weights of a path's transcripts by the exon bases that they go on beyond its 3' end (``distance``).

    w = 1 - (d + pseudo) / sum(d + pseudo) within the path, made to sum to one; a single transcript gets one.
    """
    w = Window.partitionBy("mp_id")
    own = F.col("distance") + pseudo
    d = hits.withColumns({"__all": F.sum(own).over(w), "__n": F.count(F.lit(1)).over(w)})
    # the shares 1 - d / all add up to n - 1; one division keeps the result free of the order of sums
    return d.withColumn("weight", F.when(F.col("__n") == 1, 1.0).otherwise((F.col("__all") - own) / (F.col("__all") * (F.col("__n") - 1)))).drop("__all", "__n")


def em_arrays(tx: np.ndarray, path: np.ndarray, weight: np.ndarray, reads: np.ndarray, *, alpha: float, max_iter: int, tolerance: float, start: np.ndarray | None = None, norm: str = "l2", floor: float = 0.0, mass: tuple[float, float] | None = None, moves: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Expectation-maximization over rows (transcript index, path index, weight) and reads of each path.

    Returns each row's fraction, the transcripts' proportions and the rounds taken. ``alpha`` adds that much for each
    ambiguous read of a transcript in the M step; counts never include it. Where the rows are a part of what is estimated
    together, ``mass`` has the sums of starts and of counts of all of it; ``moves`` gets each round's change.
    """
    n_tx, n_path = int(tx.max()) + 1, int(path.max()) + 1
    hits = np.bincount(path, minlength=n_path)
    extra = alpha * np.bincount(tx, weights=np.where(hits[path] > 1, reads[path], 0.0), minlength=n_tx)
    p = np.full(n_tx, 1.0 / n_tx) if start is None else np.maximum(start, floor) / (np.maximum(start, floor).sum() if mass is None else mass[0])
    frac, rounds = np.zeros(len(tx)), 0
    for rounds in range(1, max_iter + 1):
        raw = weight * p[tx]
        total = np.bincount(path, weights=raw, minlength=n_path)
        frac = np.divide(raw, total[path], out=np.zeros_like(raw), where=total[path] > 0)
        new = np.bincount(tx, weights=frac * reads[path], minlength=n_tx) + extra
        all_mass = new.sum() if mass is None else mass[1]
        new = new / all_mass if all_mass > 0 else new
        delta = np.sqrt(((new - p) ** 2).sum()) if norm == "l2" else np.abs(new - p).sum()
        p = np.maximum(new, floor)
        if moves is not None:
            moves.append(float(delta))
        if tolerance and delta < tolerance:
            break
    return frac, p, rounds


def path_classes(tracking: DataFrame) -> DataFrame:
    """(gene_id, txs, n_reads): reads of a gene that hit the same transcripts, summed up before any gene is gathered."""
    sets = tracking.groupBy("gene_id", "read_id").agg(F.array_sort(F.collect_set("tx_id")).alias("txs"))
    return sets.groupBy("gene_id", "txs").agg(F.count(F.lit(1)).cast("double").alias("n_reads"))


def em_per_gene(classes: DataFrame, *, alpha: float = 0.01, max_iter: int = 250, tolerance: float = 1e-6) -> DataFrame:
    """K3: (gene_id, tx_id, all_reads, proportion, n_rounds) from path classes; weights within a class are equal, or those
    of an array ``weights`` in the order of ``txs``.

    Genes are independent, so each is one group without a shuffle for each round; a group has a row for each distinct set
    of transcripts, not for each read.
    """
    gene, tx = (classes.schema[c].dataType for c in ("gene_id", "txs"))

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("n_reads", kind="stable").reset_index(drop=True)
        size = df["txs"].map(len).to_numpy()
        names, idx = np.unique(np.concatenate(df["txs"].to_list()), return_inverse=True)
        path = np.repeat(np.arange(len(df)), size)
        reads = df["n_reads"].to_numpy(float)
        weight = np.concatenate(df["weights"].to_list()) if "weights" in df else 1.0 / size[path]
        frac, p, rounds = em_arrays(idx, path, weight, reads, alpha=alpha, max_iter=max_iter, tolerance=tolerance)
        counts = np.bincount(idx, weights=frac * reads[path], minlength=len(names))
        return pd.DataFrame({"gene_id": df["gene_id"].iloc[0], "tx_id": names, "all_reads": counts, "proportion": p, "n_rounds": rounds})

    return classes.groupBy("gene_id").applyInPandas(fit, f"gene_id {gene.simpleString()}, tx_id {tx.elementType.simpleString()}, all_reads double, proportion double, n_rounds int")


def em_rounds(tracking: DataFrame, rounds: int) -> DataFrame:
    """K3 in DataFrame operations only, for components too large for one task: a fixed number of rounds, alpha 0.

    (gene_id, tx_id, all_reads). Path classes are written once; each round is one join and one sum over them.
    """
    c = path_classes(tracking).withColumn("mp_id", F.monotonically_increasing_id())
    rows = write_through(c.select("gene_id", "mp_id", "n_reads", F.explode("txs").alias("tx_id")), "em-rows")
    p = rows.select("gene_id", "tx_id").distinct().withColumn("p", F.lit(1.0))
    for k in range(rounds):
        e = rows.join(p, ["gene_id", "tx_id"])
        total = e.groupBy("gene_id", "mp_id").agg(F.sum("p").alias("total"))
        counts = e.join(total, ["gene_id", "mp_id"]).groupBy("gene_id", "tx_id").agg(F.sum(F.col("p") / F.col("total") * F.col("n_reads")).alias("p"))
        p = write_through(counts, "em") if k % 5 == 4 else counts
    return p.select("gene_id", "tx_id", F.col("p").alias("all_reads"))


def em_to_end(classes: DataFrame, *, alpha: float = 0.01, max_iter: int = 250, tolerance: float = 1e-6, counts: DataFrame | None = None, norm: str = "l2", floor: float = 0.0) -> DataFrame:
    """K3 for genes of any size: what :func:`em_per_gene` gives, in DataFrame operations only.

    A round joins the proportions to the classes' rows and sums up twice; it is written, and the one before it deleted.
    Genes leave as soon as they have converged, so later rounds work on what is left. ``counts`` (gene_id, tx_id, start)
    are what it starts from, else equal shares; the result's ``before`` is what the last round's fractions were made from.
    """
    spark, ambiguous = classes.sparkSession, F.size("txs") > 1
    weights = F.col("weights") if "weights" in classes.columns else F.transform("txs", lambda _: F.lit(1.0) / F.size("txs"))
    c = classes.withColumns({"mp_id": F.monotonically_increasing_id(), "h": F.arrays_zip(F.col("txs").alias("tx_id"), weights.alias("weight"))})
    rows, rows_at = stored(c.select("gene_id", "mp_id", "n_reads", ambiguous.alias("shared"), F.inline("h").alias("tx_id", "weight")), "em-rows")
    extra = F.lit(float(alpha)) * F.sum(F.when(F.col("shared"), F.col("n_reads")).otherwise(0.0))
    start = rows.groupBy("gene_id", "tx_id").agg(extra.alias("extra"))
    first = F.lit(1.0) if counts is None else F.greatest(F.coalesce("start", F.lit(0.0)), F.lit(floor))
    start = (start if counts is None else start.join(counts, ["gene_id", "tx_id"], "left")).withColumn("first", first)
    n = start.groupBy("gene_id").agg(F.sum("first").alias("n"))
    state, path = stored(start.join(n, "gene_id").select("gene_id", "tx_id", "extra", (F.col("first") / F.col("n")).alias("p")), "em-state")
    parts = []
    for k in range(1, max_iter + 1):
        e = rows.join(state.select("gene_id", "tx_id", "p"), ["gene_id", "tx_id"]).withColumn("raw", F.col("weight") * F.col("p"))
        total = e.groupBy("mp_id").agg(F.sum("raw").alias("total"))
        share = F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(0.0)
        summed = e.join(total, "mp_id").groupBy("gene_id", "tx_id").agg(F.sum(share * F.col("n_reads")).alias("all_reads"))
        new = state.join(summed, ["gene_id", "tx_id"]).withColumn("raw", F.col("all_reads") + F.col("extra"))
        gene = new.groupBy("gene_id").agg(F.sum("raw").alias("mass"))
        new = new.join(gene, "gene_id").withColumn("new", F.when(F.col("mass") > 0, F.col("raw") / F.col("mass")).otherwise(0.0))
        step, step_at = stored(new.select("gene_id", "tx_id", "extra", "p", "new", "all_reads"), "em-step")
        moved = step.groupBy("gene_id").agg((F.sqrt(F.sum((F.col("new") - F.col("p")) * (F.col("new") - F.col("p")))) if norm == "l2" else F.sum(F.abs(F.col("new") - F.col("p")))).alias("moved"))
        over = moved.where(F.lit(k == max_iter) | (F.lit(tolerance > 0) & (F.col("moved") < tolerance))).select("gene_id")
        parts.append(write_through(step.join(over, "gene_id", "left_semi").select("gene_id", "tx_id", "all_reads", F.greatest("new", F.lit(floor)).alias("proportion"), F.lit(k).alias("n_rounds"), F.col("p").alias("before")), "em-done"))
        after, after_at = stored(step.join(over, "gene_id", "left_anti").select("gene_id", "tx_id", "extra", F.greatest("new", F.lit(floor)).alias("p")), "em-state")
        discard(spark, path, step_at)
        state, path = after, after_at
        if state.isEmpty():
            break
    discard(spark, rows_at, path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def estimate(classes: DataFrame, *, most_rows: int = 2_000_000, **how: float) -> DataFrame:
    """K3: genes with at most ``most_rows`` pairs of class and transcript as one group each, larger ones in rounds.

    Both give the same estimate up to rounding; ``classes`` should be written, as it is read for both.
    """
    size = classes.groupBy("gene_id").agg(F.sum(F.size("txs")).alias("n"))
    large = write_through(size.where(F.col("n") > most_rows).select("gene_id"), "large-genes")
    if large.isEmpty():
        return em_per_gene(classes, **how)
    small = em_per_gene(classes.join(large, "gene_id", "left_anti"), **how)
    return small.unionByName(em_to_end(classes.join(large, "gene_id", "left_semi"), **how).drop("before"))


def expression_report(tracking: DataFrame, counts: DataFrame, *, total_records: int | None = None) -> DataFrame:
    """One row for each transcript, from assignments and estimated counts (gene_id, tx_id, all_reads).

    uniq_reads, all_reads, isoform_fraction, unique_gene_read_fraction, tpm over all reported rows, and rpm over
    ``total_records``. The one-row total travels as a broadcast, which keeps the rest parallel.
    """
    n = tracking.groupBy("gene_id", "read_id").agg(F.count(F.lit(1)).alias("n"), F.first("tx_id").alias("tx_id"))
    uniq = n.where("n = 1").groupBy("gene_id", "tx_id").agg(F.count(F.lit(1)).alias("uniq_reads"))
    gene = counts.groupBy("gene_id").agg(F.sum("all_reads").alias("gene_reads"))
    total = counts.agg(F.sum("all_reads").alias("total_reads"))
    d = counts.join(uniq, ["gene_id", "tx_id"], "left").join(gene, "gene_id").join(F.broadcast(total), F.lit(True))
    share = F.when(F.col("gene_reads") > 0, F.col("all_reads") / F.col("gene_reads")).otherwise(0.0)
    unique = F.coalesce("uniq_reads", F.lit(0))
    out = d.select("gene_id", "tx_id", unique.alias("uniq_reads"), "all_reads", share.alias("isoform_fraction"), F.when(F.col("gene_reads") > 0, unique / F.col("gene_reads")).otherwise(0.0).alias("unique_gene_read_fraction"), F.when(F.col("total_reads") > 0, F.col("all_reads") / F.col("total_reads") * 1e6).otherwise(0.0).alias("tpm"))
    return out if total_records is None else out.withColumn("rpm", F.col("all_reads") / total_records * 1e6)


def bases_behind(transcripts: DataFrame, lengths: DataFrame) -> DataFrame:
    """K2: (tx_id, nodes, rest): each transcript's nodes from its 3' end, and the bases of those behind each of them.

    Paths run from the 5' end; ``lengths`` has node and length, and nodes without one count as zero.
    """
    w = Window.partitionBy("tx_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    nodes = transcripts.select("tx_id", F.posexplode("path").alias("place", "node")).join(lengths, "node", "left")
    rest = nodes.select("tx_id", F.struct((-F.col("place")).alias("place"), "node", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("rest")).alias("n"))
    d = rest.groupBy("tx_id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    d = transcripts.select("tx_id").distinct().join(d, "tx_id", "left")  # those without nodes stay
    return d.select("tx_id", F.coalesce(F.col("n.node"), F.array().cast("array<string>")).alias("nodes"), F.coalesce(F.col("n.rest"), F.array().cast("array<bigint>")).alias("rest"))


def quantify_paths(reads: DataFrame, transcripts: DataFrame, lengths: DataFrame | None = None, *, em: bool = True, alpha: float = 0.01, max_iter: int = 250, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """From reads' paths (read_id, path, lend, rend) and transcripts (gene_id, tx_id, path) to both reports.

    Distinct paths are counted, anchored to the genes with which they share most nodes (ties stay), assigned to those
    genes' transcripts by the first test that holds (K1), weighted by their distance to the 3' end where ``lengths``
    are given (K2), and split by expectation-maximization in each gene (K3), or equally without ``em`` (K4).

    Returns the tracking (read_id, gene_id, tx_id, tier, frac) and the expression report of all transcripts, whose counts
    are sums of the tracking's fractions. Paths with a spacer, or that no transcript fits, are in neither. All steps up to
    the estimate run on distinct paths; reads are only counted at the start and joined back at the end.
    """
    # reads find their path again by a digest of it, not by the path itself
    key = F.substring(F.sha2(F.to_json("path"), 256), 1, 32)
    counted = write_through(path_ops.count_paths(reads).withColumn("path_id", key), "paths")
    genes = write_through(path_ops.best_anchors(counted, transcripts), "anchors")
    behind = None if lengths is None else bases_behind(transcripts, lengths)
    hits = path_ops.assign_paths(counted.select("path_id", "path"), transcripts, genes, behind=behind).join(transcripts.select("gene_id", "tx_id"), "tx_id")
    own = Window.partitionBy("gene_id", "path_id")
    if lengths is None:
        hits = hits.withColumn("weight", 1.0 / F.count(F.lit(1)).over(own))
    else:
        named = hits.withColumn("mp_id", F.struct("gene_id", "path_id"))
        hits = end_weights(named).drop("mp_id", "distance")
    hits = write_through(hits.join(counted.select("path_id", "n_reads"), "path_id"), "hits")
    if em:
        pair = F.array_sort(F.collect_list(F.struct("tx_id", F.round("weight", 9).alias("weight"))))
        sets = hits.groupBy("gene_id", "path_id").agg(pair.alias("h"), F.first("n_reads").alias("n_reads"))
        classes = sets.groupBy("gene_id", F.col("h.tx_id").alias("txs"), F.col("h.weight").alias("weights")).agg(F.sum("n_reads").cast("double").alias("n_reads"))
        fitted = estimate(write_through(classes, "classes"), alpha=alpha, max_iter=max_iter, tolerance=tolerance).select("gene_id", "tx_id", "proportion")
        part = F.col("weight") * F.col("proportion")
        total = F.sum(part).over(own)
        hits = write_through(hits.join(fitted, ["gene_id", "tx_id"]).withColumn("frac", F.when(total > 0, part / total).otherwise(0.0)), "fractions")
    else:
        hits = hits.withColumn("frac", 1.0 / F.count(F.lit(1)).over(own))
    back = reads.where(~F.array_contains("path", path_ops.SPACER)).select("read_id", key.alias("path_id")).distinct()
    tracking = back.join(hits, "path_id").select("read_id", "gene_id", "tx_id", "tier", "frac")
    sums = hits.groupBy("gene_id", "tx_id").agg(F.sum(F.col("frac") * F.col("n_reads")).alias("all_reads"))
    counts = transcripts.select("gene_id", "tx_id").join(sums, ["gene_id", "tx_id"], "left").fillna(0.0, ["all_reads"])
    return tracking, expression_report(tracking, counts)


def merge_expression(shards: list[DataFrame]) -> DataFrame:
    """Reads of the same transcript summed over shards, tpm and isoform fraction made anew."""
    d = shards[0]
    for s in shards[1:]:
        d = d.unionByName(s, allowMissingColumns=True)
    d = d.groupBy("gene_id", "tx_id").agg(F.sum("all_reads").alias("all_reads"))
    gene = Window.partitionBy("gene_id")
    total = d.agg(F.sum("all_reads").alias("__total"))
    return d.withColumn("isoform_fraction", F.col("all_reads") / F.sum("all_reads").over(gene)).join(F.broadcast(total), F.lit(True)).withColumn("tpm", F.col("all_reads") / F.col("__total") * 1e6).drop("__total")


def cross_gene_em(tracking: DataFrame, counts: DataFrame, *, alpha: float = 0.01, max_iter: int = 250, tolerance: float = 1e-9, floor: float = 1e-8, most_rows: int = 2_000_000) -> DataFrame:
    """Read fractions re-estimated over genes that share reads; (gene_id, tx_id, read_id, frac) for all rows.

    ``tracking`` has frac and read_weight 1 for each row. Genes are linked by reads that hit more than one; each
    component starts from the given counts. Rows outside of components pass through.

    Within a component, transcripts that no chain of reads connects only meet in the totals and in the rule to stop. Each
    such part is one group: it runs all rounds to tell its share of each round's change, and again as many rounds as the
    sum over the component asks for. Components with a part above ``most_rows`` run in rounds of joins and sums.
    """
    genes = tracking.groupBy("read_id").agg(F.array_sort(F.collect_set("gene_id")).alias("genes")).where(F.size("genes") > 1)
    links = genes.select(F.element_at("genes", 1).alias("u"), F.explode(F.slice("genes", 2, F.size("genes"))).alias("v")).distinct()
    parts = connected_components(links).select(F.col("vertex").alias("gene_id"), "component")
    linked = write_through(tracking.join(parts, "gene_id", "left"), "linked")
    free = linked.where("component IS NULL").select("gene_id", "tx_id", "read_id", "frac")
    pair = F.struct("gene_id", "tx_id")
    sets = write_through(linked.where("component IS NOT NULL").groupBy("component", "read_id").agg(F.array_sort(F.collect_set(pair)).alias("hits")), "sets")
    classes = sets.groupBy("component", "hits").agg(F.count(F.lit(1)).cast("double").alias("n_reads"))
    inner = connected_components(classes.select(F.element_at("hits", 1).alias("u"), F.explode("hits").alias("v")).distinct())
    classes = classes.withColumn("vertex", F.element_at("hits", 1)).join(inner.withColumnRenamed("component", "part"), "vertex", "left")
    classes = write_through(classes.select("component", F.coalesce("part", "vertex").alias("part"), "hits", F.xxhash64("hits").alias("mp"), "n_reads"), "classes")
    size = classes.groupBy("component", "part").agg(F.sum(F.size("hits")).alias("n"))
    large = write_through(size.where(F.col("n") > most_rows).select("component").distinct(), "large")
    starts = counts.select("gene_id", "tx_id", F.col("all_reads").alias("start"))
    rows = classes.join(large, "component", "left_anti").select("component", "part", "mp", "n_reads", F.explode("hits").alias("h")).select("component", "part", "mp", "n_reads", "h.gene_id", "h.tx_id")
    rows = write_through(rows.join(starts, ["gene_id", "tx_id"], "left"), "rows")
    # the sums of starts and of counts over a component, which every part's proportions are shares of
    begun = rows.groupBy("component", "gene_id", "tx_id").agg(F.first("start").alias("start")).groupBy("component").agg(F.sum(F.greatest(F.coalesce("start", F.lit(0.0)), F.lit(floor))).alias("begun"))
    reads = classes.groupBy("component").agg(F.sum(F.col("n_reads") * F.when(F.size("hits") > 1, 1 + alpha * F.size("hits")).otherwise(1.0)).alias("mass"))
    masses = begun.join(reads, "component")

    def run(df: pd.DataFrame, rounds: int, moves: list[float] | None) -> np.ndarray:
        g, t = pd.factorize(df["gene_id"], use_na_sentinel=False)[0], pd.factorize(df["tx_id"], use_na_sentinel=False)[0]
        tx = pd.factorize(g * (int(t.max()) + 1) + t)[0]
        path, _ = pd.factorize(df["mp"])
        n_reads, start = np.zeros(path.max() + 1), np.zeros(tx.max() + 1)
        n_reads[path], start[tx] = df["n_reads"].to_numpy(float), df["start"].fillna(0).to_numpy(float)
        mass = float(df["begun"].iloc[0]), float(df["mass"].iloc[0])
        return em_arrays(tx, path, np.ones(len(df)), n_reads, alpha=alpha, max_iter=rounds, tolerance=0.0, start=start, norm="l1", floor=floor, mass=mass, moves=moves)[0]

    def watch(df: pd.DataFrame) -> pd.DataFrame:
        moves: list[float] = []
        run(df, max_iter, moves)
        return pd.DataFrame({"component": [df["component"].iloc[0]] * len(moves), "round": range(1, len(moves) + 1), "moved": moves})

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        return df[["gene_id", "tx_id", "mp"]].assign(frac=run(df, int(df["rounds"].iloc[0]), None))

    g, t = (tracking.schema[c].dataType.simpleString() for c in ("gene_id", "tx_id"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many rounds
    known = rows.join(F.broadcast(masses), "component")
    moved = known.repartition(spread, "component", "part").groupBy("component", "part").applyInPandas(lambda df: watch(df.drop(columns="part")), f"component {g}, round int, moved double")
    moved = moved.groupBy("component", "round").agg(F.sum("moved").alias("moved"))
    still = F.lit(tolerance > 0) & (F.col("moved") < tolerance)
    until = write_through(moved.groupBy("component").agg(F.coalesce(F.min(F.when(still, F.col("round"))), F.max("round")).alias("rounds")), "rounds")
    fitted = known.join(F.broadcast(until), "component").repartition(spread, "component", "part").groupBy("component", "part").applyInPandas(lambda df: fit(df.drop(columns="part")), f"gene_id {g}, tx_id {t}, mp long, frac double")
    if not large.isEmpty():
        wide = classes.join(large, "component", "left_semi").select(F.col("component").alias("gene_id"), F.col("hits").alias("txs"), "mp", "n_reads")
        own = wide.select("gene_id", F.explode("txs").alias("tx_id")).distinct().select("gene_id", "tx_id", F.col("tx_id.gene_id").alias("g"), F.col("tx_id.tx_id").alias("t"))
        own = own.join(starts.select(F.col("gene_id").alias("g"), F.col("tx_id").alias("t"), "start"), ["g", "t"], "left").select("gene_id", "tx_id", "start")
        p = em_to_end(wide.drop("mp"), alpha=alpha, max_iter=max_iter, tolerance=tolerance, counts=own, norm="l1", floor=floor).select("gene_id", "tx_id", "before")
        share = wide.select("gene_id", "mp", F.explode("txs").alias("tx_id")).join(p, ["gene_id", "tx_id"]).withColumn("frac", F.col("before") / F.sum("before").over(Window.partitionBy("gene_id", "mp")))
        fitted = fitted.unionByName(share.select("tx_id.gene_id", "tx_id.tx_id", "mp", "frac"))
    back = sets.select("read_id", F.xxhash64("hits").alias("mp"), F.explode("hits").alias("h")).select("read_id", "mp", "h.gene_id", "h.tx_id").join(fitted, ["mp", "gene_id", "tx_id"])
    return free.unionByName(back.select("gene_id", "tx_id", "read_id", "frac"))


def rpm_scale(expression: DataFrame) -> DataFrame:
    """K6: the median of rpm / all_reads over rows with reads."""
    return expression.where("all_reads > 0").agg(F.percentile(F.col("rpm") / F.col("all_reads"), 0.5).alias("scale"))


def feature_counts(tracking: DataFrame) -> DataFrame:
    """Sums of frac by cell for genes and transcripts in one pass (level, feature_id, cell, value)."""
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).cast("string").alias("feature_id")) for n, c in (("gene", "gene_id"), ("isoform", "tx_id"))])).alias("f")
    return tracking.select(levels, "cell", "frac").groupBy("f.level", "f.feature_id", "cell").agg(F.sum("frac").alias("value"))


def unique_pattern_counts(tracking: DataFrame) -> DataFrame:
    """By pattern (tx_id) and cell, reads with that pattern only."""
    one = tracking.groupBy("read_id").agg(F.min("tx_id").alias("tx_id"), F.max("tx_id").alias("__max"), F.min("cell").alias("cell")).where(F.col("tx_id") == F.col("__max"))
    return one.groupBy("tx_id", "cell").agg(F.count(F.lit(1)).alias("n_reads"))


def pseudobulk(tracking: DataFrame, clusters: DataFrame, names: list[str]) -> DataFrame:
    """Sums of frac by transcript, one column for each cluster of ``names``; cells without one are dropped."""
    d = tracking.join(clusters, "cell")
    return d.groupBy("gene_id", "tx_id").pivot("cluster", names).agg(F.sum("frac")).fillna(0.0)


def detection_fraction(tracking: DataFrame, clusters: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Share of a cluster's cells with ``least`` reads or more of a transcript; absent cells count as zero."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    cells = tracking.groupBy("gene_id", "tx_id", "cell").agg(F.sum("frac").alias("n")).join(clusters, "cell")
    return cells.groupBy("gene_id", "tx_id", "cluster").agg(F.count_if(F.col("n") >= least).alias("k")).join(size, "cluster").select("gene_id", "tx_id", "cluster", (F.col("k") / F.col("size")).alias("fraction"))


def dedupe_tracking(tracking: DataFrame) -> DataFrame:
    """One row for each (read, gene, transcript) with the largest weight."""
    return tracking.groupBy("read_id", "gene_id", "tx_id").agg(F.max("read_weight").alias("read_weight"))


def assignment_audit(tracking: DataFrame) -> DataFrame:
    """Reads, ambiguous reads and their share by gene, with a total row (gene_id null)."""
    reads = tracking.groupBy("gene_id", "read_id").agg(F.count(F.lit(1)).alias("n"))
    return reads.rollup("gene_id").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(F.col("n") > 1).alias("n_ambiguous")).withColumn("share", F.col("n_ambiguous") / F.col("n_reads"))


def fractional_counts(lists: DataFrame, *, sep: str = ",") -> DataFrame:
    """Each of the k ids of a read's list gets 1/k."""
    parts = F.split("ids", sep)
    return lists.select(F.explode(parts).alias("id"), (1.0 / F.size(parts)).alias("f")).groupBy("id").agg(F.sum("f").alias("count"))


def length_tpm_bins(expression: DataFrame) -> DataFrame:
    """Transcripts by length and tpm class (classes' lower bounds)."""

    def lower(c: str, bounds: list[float]) -> Column:
        out = F.lit(float(bounds[0]))
        for b in bounds[1:]:
            out = F.when(F.col(c) >= b, float(b)).otherwise(out)
        return out

    d = expression.select(lower("length", [0, 500, 1000, 2000, 3000, 5000]).alias("length_bin"), lower("tpm", [0, 0.25, 1, 4, 16, 64, 256]).alias("tpm_bin"))
    return d.groupBy("length_bin", "tpm_bin").agg(F.count(F.lit(1)).alias("n"))


def filter_isoforms(classes: DataFrame, *, min_fraction: float = 0.01, alpha: float = 0.0, max_iter: int = 1000) -> DataFrame:
    """C14: drop a gene's weakest isoform below ``min_fraction``, estimate anew, and so on until none is left below.

    Ties of the smallest fraction go to the largest tx_id. (gene_id, tx_id, all_reads, isoform_fraction).
    """
    gene, tx = (classes.schema[c].dataType for c in ("gene_id", "txs"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        size = df["txs"].map(len).to_numpy()
        names, tx = np.unique(np.concatenate(df["txs"].to_list()), return_inverse=True)
        path, reads = np.repeat(np.arange(len(df)), size), df["n_reads"].to_numpy(float)
        alive, hits, alone = np.ones(len(names), bool), size.copy(), np.zeros(len(names))
        while True:
            # what has one isoform left is a single number for each isoform; rows of the rest shrink with every drop
            last = hits[path] == 1
            alone += np.bincount(tx[last], weights=reads[path[last]], minlength=len(names))
            tx, path = tx[~last], path[~last]
            kept, place = np.flatnonzero(alive), np.cumsum(alive) - 1
            near, group = np.unique(path, return_inverse=True)
            at, row = np.concatenate([place[kept], place[tx]]), np.concatenate([np.arange(len(kept)), len(kept) + group])
            n, many = np.concatenate([alone[kept], reads[near]]), np.concatenate([np.ones(len(kept)), hits[near]])
            frac, _, _ = em_arrays(at, row, 1.0 / many[row], n, alpha=alpha, max_iter=max_iter, tolerance=1e-6)
            counts = np.bincount(at, weights=frac * n[row], minlength=len(kept))
            share = counts / counts.sum() if counts.sum() else counts
            weak = np.flatnonzero(share < min_fraction)
            if not len(weak) or len(kept) == 1:
                return pd.DataFrame({"gene_id": df["gene_id"].iloc[0], "tx_id": names[kept], "all_reads": counts, "isoform_fraction": share})
            drop = kept[weak[share[weak] == share[weak].min()].max()]
            alive[drop], gone = False, tx == drop
            hits[path[gone]] -= 1
            tx, path = tx[~gone], path[~gone]

    return classes.groupBy("gene_id").applyInPandas(run, f"gene_id {gene.simpleString()}, tx_id {tx.elementType.simpleString()}, all_reads double, isoform_fraction double")




def sample_matrices(counts: DataFrame, samples: list[str]) -> DataFrame:
    """(id, sample, n) as one row for each id with <sample>_count and <sample>_TPM (count / sample's total * 1e6).

    The pivot is an outer union: an id that a sample lacks has 0 there. Totals are one row for each sample.
    """
    totals = counts.groupBy("sample").agg(F.sum("n").alias("total"))
    d = counts.join(totals, "sample").withColumn("tpm", F.col("n") / F.col("total") * 1e6)
    cols = [F.coalesce(F.sum(F.when(F.col("sample") == x, F.col(c))), F.lit(0.0)).alias(f"{x}_{name}") for x in samples for c, name in (("n", "count"), ("tpm", "TPM"))]
    return d.groupBy("id").agg(*cols)


def corrected_tables(tracking: DataFrame, corrected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracking with new fractions where ``corrected`` has them, and the expression that follows from it.

    Both have read_id, gene_id and tx_id, the first frac and the second new_frac. A read without a new fraction keeps
    its own.
    """
    d = tracking.join(corrected.select("read_id", "gene_id", "tx_id", "new_frac"), ["read_id", "gene_id", "tx_id"], "left")
    d = d.withColumn("frac", F.coalesce("new_frac", "frac")).drop("new_frac")
    counts = d.groupBy("gene_id", "tx_id").agg(F.sum("frac").alias("all_reads"))
    return d, merge_expression([counts])


def cluster_fractions(counts: DataFrame, fractions: DataFrame) -> DataFrame:
    """Counts (gene_id, tx_id, cluster, n) with the share of the cluster's cells that express the transcript; 0 where none is known."""
    return counts.join(fractions.select("gene_id", "tx_id", "cluster", "fraction"), ["gene_id", "tx_id", "cluster"], "left").fillna(0.0, ["fraction"])


def listed_codes(rows: DataFrame, codes: DataFrame, ids: str, *, sep: str = ",") -> DataFrame:
    """``rows`` (id, ``ids``: joined ids) with the ids' codes in the same order, N/A where one has none.

    ``codes`` has tx_id and code; of several codes of an id the least counts.
    """
    one = rows.select("id", F.posexplode(F.split(ids, sep)).alias("place", "tx_id"))
    known = codes.groupBy("tx_id").agg(F.min("code").alias("code"))
    named = one.join(known, "tx_id", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("code", F.lit("N/A")).alias("code")))).alias("c"))
    return rows.join(named, "id", "left").withColumn("codes", F.array_join(F.transform("c", lambda x: x["code"]), sep)).drop("c")


def id_map(tracking: DataFrame, *cols: str) -> DataFrame:
    """The distinct ids that occur together."""
    return tracking.select(*cols).distinct()


def resource_summary(samples: DataFrame) -> DataFrame:
    """Peak and mean of memory and load, and the duration, of each process (process, seconds, memory, load)."""
    return samples.groupBy("process").agg(F.count(F.lit(1)).alias("n_samples"), F.max("memory").alias("peak_memory"), F.avg("memory").alias("mean_memory"), F.max("load").alias("peak_load"), F.avg("load").alias("mean_load"), (F.max("seconds") - F.min("seconds")).alias("duration"))


def bulk_filter(counts: DataFrame, *, min_cpm: float = 1.0, min_samples: int = 2, min_isoforms: int = 2) -> DataFrame:
    """(gene_id, tx_id, sample, n, cpm, fraction) of transcripts with enough counts per million in enough samples.

    Genes that keep fewer than ``min_isoforms`` transcripts go. ``fraction`` is the transcript's share of its gene's
    counts in the sample, among what is kept.
    """
    totals = counts.groupBy("sample").agg(F.sum("n").alias("total"))
    d = counts.join(totals, "sample").withColumn("cpm", F.col("n") / F.col("total") * 1e6)
    good = d.groupBy("gene_id", "tx_id").agg(F.count_if(F.col("cpm") >= min_cpm).alias("k")).where(F.col("k") >= min_samples)
    genes = good.groupBy("gene_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_isoforms).select("gene_id")
    d = d.join(good.join(genes, "gene_id", "left_semi").select("gene_id", "tx_id"), ["gene_id", "tx_id"], "left_semi")
    w = Window.partitionBy("gene_id", "sample")
    return d.select("gene_id", "tx_id", "sample", "n", "cpm", (F.col("n") / F.sum("n").over(w)).alias("fraction"))


def normalized_cells(counts: DataFrame, *, min_cells: int = 10, min_features: int = 1000, scale: float = 1e4) -> DataFrame:
    """(cell, feature, value): log(1 + share of the cell's counts times ``scale``) after both minima.

    Features in fewer than ``min_cells`` cells go first, then cells with fewer than ``min_features`` of the rest.
    """
    often = counts.where("n > 0").groupBy("feature").agg(F.count_distinct("cell").alias("k")).where(F.col("k") >= min_cells).select("feature")
    d = counts.where("n > 0").join(often, "feature", "left_semi")
    cells = d.groupBy("cell").agg(F.sum("n").alias("total"), F.count_distinct("feature").alias("k")).where(F.col("k") >= min_features)
    return d.join(cells.select("cell", "total"), "cell").select("cell", "feature", F.log1p(F.col("n") / F.col("total") * scale).alias("value"))
