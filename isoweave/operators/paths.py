"""Path operators: counting, anchoring, the assignment cascade and splice compatibility (sections D, E, I, J, K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SPACER, bind, compatible_paths, contains_path, path_relation, trim_boundaries
from ..runtime import write_through


def count_paths(reads: DataFrame) -> DataFrame:
    """Distinct reads of each node path (read_id, path, lend, rend), with the span of its reads.

    A read counts once for a path; paths with a spacer are left out.
    """
    d = reads.where(~F.array_contains("path", "???")).groupBy("path", "read_id").agg(F.min("lend").alias("lend"), F.max("rend").alias("rend"))
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("n_reads"), F.min("lend").alias("lend"), F.max("rend").alias("rend"))


def first_clean_path(reads: DataFrame) -> DataFrame:
    """Each read's first path (by ordinal) without a spacer; reads without one are lost."""
    return reads.where(~F.array_contains("path", "???")).groupBy("read_id").agg(F.min_by("path", "ordinal").alias("path"))


def anchors(paths: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Genes that share nodes with each path (path_id, path), with their number, by an inverted index of nodes."""
    index = transcripts.select("gene_id", F.explode("path").alias("node")).distinct()
    return paths.select("path_id", F.explode(F.array_distinct("path")).alias("node")).join(index, "node").groupBy("path_id", "gene_id").agg(F.count(F.lit(1)).alias("shared"))


def best_anchors(paths: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The genes that share most nodes with each path (path_id, gene_id, shared); ties stay.

    A node brings the list of its genes, and a path counts what it got: pairs of path and gene are neither shuffled, hashed
    nor sorted, and only those that stay become rows.
    """
    index = transcripts.select("gene_id", F.explode("path").alias("node")).distinct().where("node IS NOT NULL")
    index = index.groupBy("node").agg(F.collect_list("gene_id").alias("genes"), F.count_if(F.col("gene_id").isNull()).alias("nulls"))
    own = paths.select("path_id", F.explode(F.array_distinct("path")).alias("node"))
    got = own.join(index, "node").groupBy("path_id").agg(F.flatten(F.collect_list("genes")).alias("g"), F.sum("nulls").alias("nulls"))
    item = lambda gene, n: F.struct(gene.alias("gene_id"), n.cast("long").alias("shared"))

    def counted(g: Column) -> Column:
        # what is used more than once is bound, as it is else made again for each use
        starts = F.filter(F.transform(g, lambda x, k: k), lambda k: (k == 0) | (F.get(g, k) != F.get(g, k - 1)))
        return bind(starts, lambda at: F.transform(at, lambda x, k: item(F.get(g, x), F.coalesce(F.get(at, k + 1), F.size(g)) - x)))

    def best(runs: Column) -> Column:
        return bind(F.array_max(F.transform(runs, lambda x: x["shared"])), lambda most: F.filter(runs, lambda x: x["shared"] == most))

    none = F.array(item(F.lit(None).cast(transcripts.schema["gene_id"].dataType), F.col("nulls")))
    runs = bind(F.sort_array("g"), counted)
    all_runs = F.when(F.col("nulls") > 0, F.concat(runs, none)).otherwise(runs)
    return got.select("path_id", F.explode(bind(all_runs, best)).alias("r")).select("path_id", "r.gene_id", "r.shared")


def majority(shared: DataFrame, by: str = "gene_id") -> DataFrame:
    """what shares most with each path; ties stay."""
    w = Window.partitionBy("path_id").orderBy(F.desc("shared"))
    return shared.withColumn("__r", F.rank().over(w)).where("__r = 1").select("path_id", by, "shared")


def assign_paths(paths: DataFrame, transcripts: DataFrame, genes: DataFrame | None = None, *, behind: DataFrame | None = None) -> DataFrame:
    """(path_id, tx_id, tier) by the first test that any transcript passes.

    1 equal, 2 contained in the transcript, 3 containing it, 4 compatible; 5 to 8 the same without boundary nodes.
    Candidates share a node, so no path meets all transcripts; with ``genes`` (path_id, gene_id) they are those of the
    path's genes that hold its first node or whose own first node it holds, as every test needs, and a path that is nothing
    but boundaries also meets the like. Each path is then moved once for each of its genes, not for each candidate.

    ``behind`` (tx_id, ``nodes``: the path from its 3' end, ``rest``: bases behind each of them), with ``genes``, adds
    ``distance``: the bases behind the last node that both share, 0 if none (K2).
    """
    # all tests but equality need a shared node; paths without any, or of boundaries only, can be equal and share null
    def bare(path: Column) -> Column:
        return F.size(F.filter(path, lambda x: x.isNotNull() & ~(x.startswith("TSS:") | x.startswith("POLYA:")))) == 0

    def keys(d: DataFrame, *ids: str) -> DataFrame:
        nodes = F.concat("path", F.when(bare(F.col("path")), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
        return d.select(*ids, F.explode(F.array_distinct(nodes)).alias("node"))

    def sides(d: DataFrame, more: str = "") -> DataFrame:
        path = F.col("path")
        out = d.withColumns({f"__path{more}": path, f"__cut{more}": trim_boundaries(path)})
        return out.withColumn(f"__ended{more}", F.size(f"__cut{more}") < F.size(path)).drop("path")

    own, theirs = sides(paths.select("path_id", "path")), sides(transcripts, "2")
    if genes is None:
        near = keys(paths, "path_id").join(keys(transcripts, "tx_id"), "node").select("path_id", "tx_id").distinct()
        d, distance = near.join(own, "path_id").join(theirs.drop("gene_id"), "tx_id"), []
    else:
        lead = F.array_distinct(F.filter(F.array(F.get("path", F.lit(0)), F.get(trim_boundaries(F.col("path")), F.lit(0))), lambda x: x.isNotNull()))
        lead = F.when(bare(F.col("path")), F.concat(lead, F.array(F.lit(None).cast("string")))).otherwise(lead)
        called = {"gene_id": "gene_id_2"}
        own_ids, their_ids = paths.join(genes.select("path_id", "gene_id"), "path_id").select("path_id", "gene_id", "path"), transcripts.withColumnsRenamed(called)
        first, whole = own_ids.select("path_id", "gene_id", F.explode(lead).alias("node")), keys(own_ids, "path_id", "gene_id")
        their_first, their_whole = their_ids.select("tx_id", "gene_id_2", F.explode(lead).alias("node")), keys(their_ids, "tx_id", "gene_id_2")
        same = lambda x, y: x["node"].eqNullSafe(y["node"]) & (x["gene_id"] == y["gene_id_2"])
        near = first.join(their_whole, same(first, their_whole)).select("gene_id", "path_id", "tx_id").unionByName(whole.join(their_first, same(whole, their_first)).select("gene_id", "path_id", "tx_id"))
        near = near.distinct()
        theirs = theirs if behind is None else theirs.join(behind, "tx_id")
        d = near.join(own, "path_id").join(theirs, ["gene_id", "tx_id"])
        shared = F.get(F.array_intersect("nodes", "__path"), F.lit(0))
        distance = [] if behind is None else [F.coalesce(F.get("rest", F.array_position("nodes", shared).cast("int") - 1), F.lit(0)).alias("distance")]

    def tests(p: Column, t: Column, then: Column) -> Column:
        # whole nodes are compared only where the last ones of what overlaps are equal
        def ends_alike(x: Column, k: Column, y: Column) -> Column:
            n = F.least(F.size(x) - k + 1, F.size(y))
            return F.get(x, k + n - 2).eqNullSafe(F.get(y, n - 1))

        def held(x: Column, k: Column, y: Column) -> Column:
            return (F.size(x) - k + 1 >= F.size(y)) & ends_alike(x, k, y) & contains_path(x, y)

        def tier_of(at: Column) -> Column:
            i, j = at["i"], at["j"]
            fits = ((i > 0) & ends_alike(t, i, p) | (i == 0) & (j > 0) & ends_alike(p, j, t)) & compatible_paths(p, t)
            return F.when(p == t, 1).when((i > 0) & held(t, i, p), 2).when((j > 0) & held(p, j, t), 3).when(fits, 4).otherwise(then)

        place = lambda x, y: F.coalesce(F.array_position(x, F.get(y, F.lit(0))).cast("int"), F.lit(0))
        return bind(F.struct(place(t, p).alias("i"), place(p, t).alias("j")), tier_of)

    # without boundary nodes the later tests are the first ones once more
    none = F.lit(None).cast("int")
    cut = F.when(F.col("__ended") | F.col("__ended2"), 4 + tests(F.col("__cut"), F.col("__cut2"), none))
    # chosen inside an array, as a filter on a long expression would have it evaluated twice
    tier = F.explode(F.filter(F.array(tests(F.col("__path"), F.col("__path2"), cut)), lambda x: x.isNotNull()))
    w = Window.partitionBy("path_id")
    d = d.withColumn("tier", tier).select("path_id", "tx_id", "tier", *distance)
    return d.withColumn("__m", F.min("tier").over(w)).where("tier = __m").drop("__m")


def subset_pairs(introns: DataFrame) -> DataFrame:
    """Ordered pairs (tx_id, tx_id_2) where all introns of the second are in the first.

    The second is looked up by its rarest intron only and its set tested where the two meet, so a pair comes once and is
    neither counted nor shuffled.
    """
    one = introns.select("tx_id", "intron").distinct()
    often = one.where("intron IS NOT NULL").groupBy("intron").agg(F.count(F.lit(1)).alias("n"))
    d = one.join(often, "intron", "left").groupBy("tx_id").agg(F.collect_list("intron").alias("set"), F.min(F.when(F.col("intron").isNotNull(), F.struct("n", "intron"))).alias("rarest"), F.count(F.lit(1)).alias("size"))
    d = write_through(d, "intron-sets")
    # a null is in no other set
    inner = d.where(F.col("size") == F.size("set")).select(F.col("tx_id").alias("tx_id_2"), F.col("set").alias("inner"), F.col("rarest.intron").alias("intron"))
    outer = d.select("tx_id", "set", F.explode("set").alias("intron"))
    return outer.join(inner, "intron").where((F.col("tx_id") != F.col("tx_id_2")) & (F.size("set") >= F.size("inner")) & (F.size(F.array_except("inner", "set")) == 0)).select("tx_id", "tx_id_2")


def subset_of_patterns(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts whose introns (ordered array) hold the read's introns one after the other."""
    index = transcripts.select("tx_id", F.col("introns").alias("tx_introns"), F.explode(F.array_distinct("introns")).alias("i"))
    need = reads.where(F.size("introns") > 0).select("read_id", "introns", F.get("introns", F.lit(0)).alias("i"))
    return need.join(index, "i").where(contains_path(F.col("tx_introns"), F.col("introns"))).select("read_id", "tx_id")


def full_matches(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Reads and transcripts with the same chain of introns."""
    return reads.where(F.size("introns") > 0).select("read_id", "introns").join(transcripts.select("tx_id", "introns"), "introns").select("read_id", "tx_id")


def collapse_patterns(rows: DataFrame) -> DataFrame:
    """Transcripts of one gene and splice pattern as one (contig, gene_id, pattern, tx_id, lend, rend)."""
    return rows.groupBy("contig", "gene_id", "pattern").agg(F.min("lend").alias("lend"), F.max("rend").alias("rend"), F.count(F.lit(1)).alias("n_members"), F.min("tx_id").alias("first_tx"))


def pattern_conflicts(rows: DataFrame) -> DataFrame:
    """Patterns that occur in more than one gene."""
    return rows.groupBy("pattern").agg(F.count_distinct("gene_id").alias("n_genes")).where("n_genes > 1")


def keep_best_path(paths: DataFrame) -> DataFrame:
    """Of equal paths the one with the best score, then the least id."""
    return paths.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "path_id")).alias("m")).select("path", (-F.col("m.s")).alias("score"), "m.path_id")


def sharing_pairs(paths: DataFrame) -> DataFrame:
    """Pairs of paths (path_id, path) that share a node, each once; path_id < path_id_2.

    All columns stand twice, those of the second path with _2. Paths travel with their nodes and a pair comes out at the
    least node that it shares, so pairs are never shuffled.
    """
    index = paths.withColumn("__node", F.explode(F.array_distinct("path")))
    other = index.withColumnsRenamed({c: f"{c}_2" for c in paths.columns})
    least = F.array_min(F.array_intersect("path", "path_2"))
    return index.join(other, "__node").where((F.col("path_id") < F.col("path_id_2")) & (F.col("__node") == least)).drop("__node")


def relations(paths: DataFrame) -> DataFrame:
    """(path_id, path_id_2, relation) of paths that share a node, each pair once; relation is that of the first."""
    return sharing_pairs(paths.select("path_id", "path")).select("path_id", "path_id_2", path_relation(F.col("path"), F.col("path_2")).alias("relation"))


def without_contained(paths: DataFrame) -> DataFrame:
    """Equal paths as their best one, then paths that stand in another one removed.

    Candidates begin with a node of the longer one, looked up by a path's first node.
    """
    best = keep_best_path(paths)
    index = best.select(F.col("path_id").alias("other"), F.explode("path").alias("first"))
    near = best.select("path_id", F.get("path", F.lit(0)).alias("first"), F.col("path").alias("own")).join(index, "first").where("path_id <> other")
    held = near.join(best.select(F.col("path_id").alias("other"), F.col("path").alias("whole")), "other").where(contains_path(F.col("whole"), F.col("own"))).select("path_id").distinct()
    return best.join(held, "path_id", "left_anti")


def path_scores(paths: DataFrame) -> DataFrame:
    """I8: (path_id, score): reads of each distinct path (path_id, path, n_reads) and of all paths that it contains."""
    index = paths.select(F.col("path_id").alias("whole_id"), F.col("path").alias("whole"), F.explode("path").alias("first"))
    inner = paths.select("path", "n_reads", F.get("path", F.lit(0)).alias("first")).join(index, "first").where(contains_path(F.col("whole"), F.col("path")))
    return inner.groupBy(F.col("whole_id").alias("path_id")).agg(F.sum("n_reads").alias("score"))


def node_support(paths: DataFrame) -> DataFrame:
    """(path_id, weight, n_nodes): the number of a path's nodes, and of paths behind them in all."""
    one = paths.select("path_id", F.explode(F.array_distinct("path")).alias("node"))
    n = one.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return one.join(n, "node").groupBy("path_id").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("n_nodes"))


def meeting(left: DataFrame, right: DataFrame, own: str, other: str) -> DataFrame:
    """Pairs of rows whose arrays ``own`` and ``other`` share a value, each once, at the least that they share.

    Arrays travel with their values and what a pair needs is there where it meets, so pairs are never shuffled.
    """
    a = left.withColumn("__node", F.explode(F.array_distinct(own)))
    b = right.withColumn("__node", F.explode(F.array_distinct(other)))
    return a.join(b, "__node").where(F.col("__node") == F.array_min(F.array_intersect(own, other))).drop("__node")


def overlap_fractions(paths: DataFrame, others: DataFrame, lengths: DataFrame) -> DataFrame:
    """(path_id, tx_id, fraction): shared bases of a read's path and a transcript's over those of the read's."""
    own = paths.select("path_id", F.explode(F.array_distinct("path")).alias("node")).join(lengths, "node")
    own = own.groupBy("path_id").agg(F.collect_list(F.struct("node", "length")).alias("n"), F.sum("length").alias("total"))
    own = own.select("path_id", F.col("n.node").alias("nodes"), F.col("n.length").alias("lengths"), "total")
    d = meeting(own, others.select("tx_id", F.col("path").alias("whole")), "nodes", "whole")
    zero = F.lit(0).cast(lengths.select(F.sum("length").alias("s")).schema["s"].dataType)
    shared = F.aggregate(F.zip_with("nodes", "lengths", lambda n, k: F.when(F.array_contains("whole", n), k)), zero, lambda s, k: s + F.coalesce(k, F.lit(0)))
    return d.select("path_id", "tx_id", (shared / F.col("total")).alias("fraction"))


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    """each path's nodes (path_id, node, lend, rend, left, right, strand) in their order, from the 5' end.

    By start, end and boundary marks on the plus strand, by end from high to low on the minus strand.
    """
    plus = F.struct("lend", "rend", "left", "right", "node")
    minus = F.struct((-F.col("rend")).alias("a"), (-F.col("lend")).alias("b"), "right", "left", "node")
    d = nodes.groupBy("path_id", "strand").agg(F.array_sort(F.collect_list(plus)).alias("p"), F.array_sort(F.collect_list(minus)).alias("m"))
    return d.select("path_id", "strand", F.when(F.col("strand") == "+", F.transform("p", lambda x: x["node"])).otherwise(F.transform("m", lambda x: x["node"])).alias("path"))


def same_introns(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(read_id, tx_id, relation) for sets of introns that share any: equal, subset, superset or mixed."""
    d = meeting(reads.select("read_id", "introns"), transcripts.select("tx_id", F.col("introns").alias("t")), "introns", "t")
    more, less = F.size(F.array_except("introns", "t")), F.size(F.array_except("t", "introns"))
    return d.select("read_id", "tx_id", F.when((more == 0) & (less == 0), "equal").when(more == 0, "subset").when(less == 0, "superset").otherwise("mixed").alias("relation"))


def best_hits(hits: DataFrame) -> DataFrame:
    """all hits of each read with its highest score."""
    w = Window.partitionBy("read").orderBy(F.desc("score"))
    return hits.withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def project_hits(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """K7: genomic blocks of hits on transcripts (read, tx_id, t_lend, t_rend); (read, tx_id, contig, strand, blocks).

    Transcript coordinates run along the exons in the direction of the strand; blocks are in the genome's.
    """
    length = lambda e: e["rend"] - e["lend"] + 1
    plus = F.when(F.col("strand") == "+", F.col("exons")).otherwise(F.reverse("exons"))
    e = transcripts.withColumn("x", plus).select("tx_id", "contig", "strand", "x", F.posexplode("x").alias("k", "e"))
    e = e.withColumn("before", F.aggregate(F.slice("x", F.lit(1), F.col("k")), F.lit(0), lambda a, y: a + length(y))).select("tx_id", "contig", "strand", "e", "before")
    d = hits.join(e, "tx_id").withColumns({"a": F.greatest("t_lend", F.col("before") + 1), "b": F.least("t_rend", F.col("before") + length(F.col("e")))}).where("a <= b")
    first, last = F.col("a") - F.col("before") - 1, F.col("b") - F.col("before") - 1
    low = F.when(F.col("strand") == "+", F.col("e.lend") + first).otherwise(F.col("e.rend") - last)
    high = F.when(F.col("strand") == "+", F.col("e.lend") + last).otherwise(F.col("e.rend") - first)
    return d.groupBy("read", "tx_id", "contig", "strand").agg(F.array_sort(F.collect_list(F.struct(low.cast("long").alias("lend"), high.cast("long").alias("rend")))).alias("blocks"))


def rescue_reads(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """K7: (read, contig, strand, blocks) of reads whose best hits all imply one place in the genome."""
    p = project_hits(best_hits(hits).select("read", "tx_id", "t_lend", "t_rend"), transcripts)
    return p.groupBy("read").agg(F.count_distinct("contig", "strand", "blocks").alias("n"), F.first("contig").alias("contig"), F.first("strand").alias("strand"), F.first("blocks").alias("blocks")).where("n = 1").drop("n")


def assigned_by_mode(genome: DataFrame, transcriptome: DataFrame, mode: str) -> DataFrame:
    """K9: (read, tx_id) of a mode: genome, transcriptome_only, rescue_unassigned or genome_tx_arb.

    Both tables have read, tx_id and identity. Rescue adds reads that the genome leaves without a transcript; in
    arbitration a read takes the side with the higher identity, the genome on ties.
    """
    g, t = genome.select("read", "tx_id"), transcriptome.select("read", "tx_id")
    if mode == "genome":
        return g
    if mode == "transcriptome_only":
        return t
    if mode == "rescue_unassigned":
        return g.unionByName(t.join(g.select("read").distinct(), "read", "left_anti"))
    if mode == "genome_tx_arb":
        a = genome.groupBy("read").agg(F.max("identity").alias("g"))
        b = transcriptome.groupBy("read").agg(F.max("identity").alias("t"))
        tx = a.join(b, "read", "full").where("g IS NULL OR t > g").select("read")
        return g.join(tx, "read", "left_anti").unionByName(t.join(tx, "read", "left_semi"))
    raise ValueError(f"unknown mode: {mode}")
