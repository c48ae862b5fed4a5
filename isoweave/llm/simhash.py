"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is seen as 32 segments of two bits; its embedding is the vector of the segments' bit counts. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so it bounds it from
below. In unary code (0, 1, 2 as 00, 01, 11) the embedding is again 64 bits, and the Manhattan distance is the bit count
of an exclusive or.

Grid range-join: the segments are dealt to ``groups`` groups. Within a Manhattan distance of d at least groups - d
groups agree exactly, so two fingerprints within range share a grid cell for at least one choice of groups - d groups.
In each cell, fingerprints are compared by the bound and then exactly. A cell of n fingerprints yields at most n - 1
links (a forest that connects what is linked in it), never all pairs. Only distinct fingerprints are joined; copies
were brought together before by a partial aggregate.

Edge cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a shingle needs make
one shingle of the whole sequence; repeated rows are returned as often as they occur; a null id is carried along and is
never a component's smallest id (a component of null ids only is null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, free_name, materialize
from .components import connected_components

LOW = 0x5555555555555555


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included."""
    import xxhash

    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(line, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return np.array([h(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Whole texts; A-Z is lower-cased."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                fps = [majority_bits(shingle_hashes((t.as_py() or b"").lower(), width, seed)) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """The segments' bit counts in unary code."""
    a, b = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(b).bitwiseAND(a), 1).bitwiseOR(fp.bitwiseOR(b).bitwiseAND(a))


def grid_masks(groups: int, distance: int) -> list[int]:
    """The bits of the unary code that make a cell, for each choice of groups - distance groups (signed)."""
    own = [sum(3 << (2 * s) for s in range(32) if s % groups == g) for g in range(groups)]
    masks = [sum(c) for c in combinations(own, groups - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def cell_forest(fps: np.ndarray, distance: int, parents: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index, root index) of every fingerprint that is linked to another one of the cell; or the one that reached it.

    A search from each unreached fingerprint; what is reached leaves the array, so a dense cell costs little more than
    one pass for each of its members over what is left.
    """
    one, two = fps & np.uint64(LOW), (fps >> np.uint64(1)) & np.uint64(LOW)
    codes = ((one & two) << np.uint64(1)) | one | two
    left = np.arange(len(fps))
    found: list[np.ndarray] = []
    roots: list[np.ndarray] = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            k = todo.pop()
            near = np.bitwise_count(codes[left] ^ codes[k]) <= distance
            if near.any():
                at = np.flatnonzero(near)
                ok = np.bitwise_count(fps[left[at]] ^ fps[k]) <= distance
                hit = left[at[ok]]
                if len(hit):
                    found.append(hit)
                    roots.append(np.full(len(hit), k if parents else root))
                    todo.extend(hit.tolist())
                    near[at[~ok]] = False
                    left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(found), np.concatenate(roots)) if found else (none, none)


def fingerprint_links(classes: DataFrame, *, distance: int = 3, groups: int = 6, parents: bool = False) -> DataFrame:
    """Links (u, v) between the ``rep`` of distinct fingerprints (fp, rep) within ``distance`` bits.

    The links connect exactly what is linked; they are not all linked pairs. With ``parents`` each link is itself within
    the distance; else it goes to the first fingerprint of its tree, which takes fewer rounds to join up.
    """
    masks = grid_masks(groups, distance)
    cells = classes.where("rep IS NOT NULL").withColumn("code", embedding(F.col("fp"))).select(
        "fp", "rep", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            choice, cell, fp, rep = cols
            cut = np.flatnonzero(np.diff(choice) | np.diff(cell)) + 1
            bounds = np.concatenate([[0], cut, [len(cell)]])
            size = np.diff(bounds)
            us, vs = [], []
            for k in np.flatnonzero(size > 1):
                a, b = bounds[k], bounds[k + 1]
                i, root = cell_forest(fp[a:b].view(np.uint64), distance, parents)
                us.append(rep[a:b][i])
                vs.append(rep[a:b][root])
            if not us:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            # the last cell may go on in the next batch
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            k = int(last[-1]) + 1 if len(last) else 0
            held = [c[k:] for c in cols]
            if k and (out := forest([c[:k] for c in cols])) is not None:
                yield out
        if held is not None and (out := forest(held)) is not None:
            yield out

    dealt = cells.select("choice", "cell", "fp", "rep").repartition("choice", "cell").sortWithinPartitions("choice", "cell", "fp")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, width: int = 3, seed: int = 42, distance: int = 3, groups: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable."""
    prints = materialize(fingerprints(docs, width=width, seed=seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # links go between fingerprints, so ids may be of any type that has an order. The count is from the files' footers;
    # distinct links stay far below one for each document and choice of groups
    parts = connected_components(fingerprint_links(classes.select("fp", F.col("fp").alias("rep")), distance=distance, groups=groups), most_edges=prints.count())
    own = classes.join(parts, classes.fp == parts.vertex, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = own.groupBy("part").agg(F.min("least").alias("component_id"))
    roots = materialize(own.join(least, "part").select("fp", "component_id"), "roots")
    return prints.join(roots, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams): the distinct hashed shingles of each row, sorted."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = [np.unique(shingle_hashes((t.as_py() or b"").lower(), width, 42)).view(np.int64) for t in part.column(1).cast(pa.binary())]
                grams = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate([*sets, np.empty(0, np.int64)]))
                yield pa.RecordBatch.from_arrays([part.column(0), grams], names=["doc_id", "grams"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, grams array<long>")


#: MinHashes that make one band of a sketch.
ROWS = 4


def set_sketch(grams: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHashes of distinct hashes, of 32 bits each."""
    rng = np.random.default_rng(97)
    mix, odd = rng.integers(0, 2**64, (2, size, 1), np.uint64)
    odd |= np.uint64(1)
    out = np.full(size, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 4096):
        out = np.minimum(out, ((grams[at : at + 4096] ^ mix) * odd).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def document_prints(docs: DataFrame, *, width: int, seed: int, tables: int, gram_width: int) -> DataFrame:
    """(doc_id, fp, same, sketch) and what other columns ``docs`` has besides its text, in one pass: the fingerprint, a
    hash of the set of ``gram_width``-word shingles, and its MinHashes, ``ROWS`` for each of ``tables`` bands. Texts
    without words have neither hash nor sketch."""
    import xxhash

    n_hashes = tables * ROWS
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ["doc_id", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                fp, same, sketches = [], [], []
                for t in part.column(1).cast(pa.binary()):
                    text = (t.as_py() or b"").lower()
                    fp.append(majority_bits(shingle_hashes(text, width, seed)))
                    grams = np.unique(shingle_hashes(text, gram_width, seed))
                    same.append(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).astype(np.int64) if len(grams) else None)
                    sketches.append(set_sketch(grams, n_hashes) if len(grams) else None)
                found = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(same, pa.int64()), pa.array(sketches, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *found], names=["doc_id", *more, "fp", "same", "sketch"])

    return docs.select("doc_id", F.col("text").cast("string"), *more).mapInArrow(run, schema + "fp long, same long, sketch array<int>")


def verified(docs: DataFrame, links: DataFrame, sketches: DataFrame, files: int, width: int, similarity: float, least_estimate: float) -> DataFrame:
    """The ``links`` (u, v) whose sketches agree in ``least_estimate`` and whose exact sets in ``similarity``.

    Texts are only moved for rows with a candidate.
    """
    sketched = links.join(sketches.select(F.col("doc_id").alias("u"), F.col("sketch").alias("a")), "u").join(sketches.select(F.col("doc_id").alias("v"), F.col("sketch").alias("b")), "v")
    equal = F.aggregate(F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    links = materialize(sketched.where(equal >= least_estimate * F.size("a")).select("u", "v").distinct().coalesce(files), "candidates")
    ends = materialize(links.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct().coalesce(files), "ends")
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]), width), "sets")
    both = links.join(sets.select(F.col("doc_id").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("grams").alias("b")), "v")
    shared, size = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return both.where((shared > 0) & (shared >= similarity * (size - shared))).select("u", "v")


#: Rows of one block of a group; each two blocks are compared in one task.
BLOCK_ROWS = 2000


def group_links(roots: np.ndarray, band: int, sketches: np.ndarray, grams: list[np.ndarray], similarity: float, least_estimate: float) -> list[tuple[int, int]]:
    """Verified links that connect all that is similar in a group, beyond what equal ``roots`` connect already.

    Every two members are compared unless they are connected by then. A pair is left to the first band that it shares.
    """
    label = np.unique(roots, return_inverse=True)[1]
    out = []
    for i in range(len(label) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(j):
            continue
        equal = sketches[j] == sketches[i]
        first = equal.reshape(len(j), -1, ROWS).all(axis=2).argmax(axis=1) == band
        for k in j[first & (equal.sum(axis=1) >= least_estimate * sketches.shape[1])].tolist():
            if label[k] == label[i]:
                continue
            shared = len(np.intersect1d(grams[i], grams[k], assume_unique=True))
            if shared >= similarity * (len(grams[i]) + len(grams[k]) - shared):
                out.append((i, k))
                label[label == label[k]] = label[i]
    return out


def rest_links(docs: DataFrame, rest: DataFrame, sketches: DataFrame, width: int, similarity: float, least_estimate: float) -> DataFrame:
    """Links (u, v) within each cell of ``rest`` (cell, band, doc_id, root), by ``group_links``.

    Rows of a large cell are dealt to blocks of about ``BLOCK_ROWS``, and each two blocks are one group, so that a cell
    with many texts is spread over tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = rest.select("doc_id").distinct()
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), width), "sets")
    blocks = rest.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = rest.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = dealt.join(sketches, "doc_id").join(sets, "doc_id").select("cell", "band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "doc_id", "root", "sketch", "grams")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("doc_id")
        roots = group.column("root").to_numpy()
        sketch = np.stack(group.column("sketch").to_numpy())
        grams = group.column("grams").to_numpy()
        found = group_links(roots, group.column("band")[0].as_py(), sketch, list(grams), similarity, least_estimate)
        u, v = [k for _, k in found], [i for i, _ in found]
        return pa.table({"u": group.column("doc_id").take(pa.array(u, pa.int64())), "v": group.column("doc_id").take(pa.array(v, pa.int64()))})

    return wide.groupBy("cell", "band", "a", "b").applyInArrow(run, f"u {kind}, v {kind}")


def similar_links(docs: DataFrame, prints: DataFrame, *, width: int = 5, similarity: float = 0.8, least_estimate: float = 0.5, placed: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that connect all rows whose sets of ``width``-word shingles have at least this Jaccard similarity.

    Candidates are texts with an equal band of ``ROWS`` MinHashes (``prints``), whose sketches agree in
    ``least_estimate``; each is verified exactly by its shingles. A pair of similarity s shares none of t bands with a
    chance of (1 - s ** 4) ** t: 2.7e-5 for 0.8 and 20 bands, 8e-10 for 0.9, whatever the edit and the length.

    Texts with equal sets are linked to the least of them, which alone goes on. In each band, those that share it are
    verified against the least one, and then what is not connected yet against each other (``rest_links``), so every
    candidate pair is verified or connected by others. ``placed`` (doc_id, root) names what is connected before.
    """
    known = prints.where("doc_id IS NOT NULL AND sketch IS NOT NULL")
    reps = known.groupBy("same").agg(F.min("doc_id").alias("rep"))
    equal = known.join(reps, "same").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    own = materialize(known.join(reps.select("same", F.col("rep").alias("doc_id")), ["same", "doc_id"], "left_semi").select("doc_id", "sketch").dropDuplicates(["doc_id"]), "sketches")
    rooted = own.withColumn("root", F.col("doc_id")) if placed is None else own.join(placed, "doc_id")
    files = max(1, -(-prints.count() // 200_000))
    bands = F.transform(F.sequence(F.lit(0), (F.size("sketch") / ROWS).cast("int") - 1), lambda k: F.xxhash64(k, F.slice("sketch", k * ROWS + 1, F.lit(ROWS))))
    cells = rooted.select("doc_id", "root", F.posexplode(bands).alias("band", "cell"))
    mixed = cells.groupBy("cell").agg(F.min("doc_id").alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell", "pivot")
    members = materialize(cells.join(mixed, "cell").where("doc_id <> pivot"), "members")
    stars = members.select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).distinct()
    first = materialize(verified(docs, stars, own, files, width, similarity, least_estimate).coalesce(files), "links")
    # what the first links connect, by roots
    root = rooted.select("doc_id", "root")
    ends = first.join(root.select(F.col("doc_id").alias("u"), F.col("root").alias("r")), "u").join(root.select(F.col("doc_id").alias("v"), F.col("root").alias("s")), "v").select(F.col("r").alias("u"), F.col("s").alias("v"))
    parts = connected_components(ends, most_edges=200_000 * files)
    left = members.join(parts.withColumnRenamed("vertex", "root"), "root", "left").select("cell", "band", "doc_id", F.coalesce("component", "root").alias("root"))
    open_cells = left.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
    rest = materialize(left.join(open_cells, "cell", "left_semi"), "rest")
    return rest_links(docs, rest, own, width, similarity, least_estimate).unionByName(first).unionByName(equal)


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text, by which rows are one document or not."""
    return F.xxhash64(F.isnull("doc_id"), F.col("doc_id").cast("string"), F.isnull("text"), F.col("text").cast("string"))


def keep_one(docs: DataFrame, *, width: int = 3, seed: int = 42, distance: int = 3, groups: int = 6, similarity: float = 0.8, gram_width: int = 5, tables: int = 20) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: that with the smallest doc_id.

    Components are those of fingerprints, joined where two texts' five-word shingles are similar by 0.8 or more
    (``similar_links``); all texts are searched. Rows are told apart by doc_id and text, so two texts that share a
    doc_id are two documents, and both stay unless they are alike. Of rows with the same doc_id and text the one with
    the least hash of all its columns stays. A null doc_id comes after all others; ties go to the smaller key.
    """
    key = row_key(docs)
    slim = docs.select(key.alias("doc_id"), "text", F.col("doc_id").alias("own"))
    prints = materialize(document_prints(slim, width=width, seed=seed, tables=tables, gram_width=gram_width), "prints")
    n = prints.count()
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    parts = connected_components(fingerprint_links(classes, distance=distance, groups=groups), most_edges=n)
    roots = classes.join(parts, classes.rep == parts.vertex, "left").select("fp", F.coalesce("component", "rep").alias("root"))
    placed = prints.groupBy("doc_id").agg(F.min("own").alias("own"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("rows"))
    placed = materialize(placed.join(roots, "fp").select("doc_id", "own", "rows", "root"), "placed")
    root = placed.select("doc_id", "root")
    alike = similar_links(slim, prints, width=gram_width, similarity=similarity, placed=root)
    joined = alike.join(root.select(F.col("doc_id").alias("u"), F.col("root").alias("r")), "u").join(root.select(F.col("doc_id").alias("v"), F.col("root").alias("s")), "v").select(F.col("r").alias("u"), F.col("s").alias("v"))
    merged = connected_components(joined, most_edges=n)
    whole = placed.join(merged.withColumnRenamed("vertex", "root"), "root", "left").withColumn("part", F.coalesce("component", "root"))
    first = F.min(F.struct(F.isnull("own").alias("nameless"), "own", "doc_id", "rows")).alias("first")
    name = free_name(docs, "kept_key")
    kept = materialize(whole.groupBy("part").agg(first).select(F.col("first.doc_id").alias(name), F.col("first.rows").alias("rows")), "kept")
    # merge joins at any size: texts move once, by a key of which each value stands once
    single = docs.join(kept.where("rows = 1").select(name).hint("merge"), key == F.col(name), "left_semi")
    often = materialize(kept.where("rows > 1").select(name), "often")
    if often.isEmpty():
        return single
    row = F.struct(*[docs[c] for c in docs.columns])
    repeated = docs.join(often, key == F.col(name))
    repeated = repeated.groupBy(name).agg(F.min_by(row, F.xxhash64(*[docs[c] for c in docs.columns])).alias("row")).select("row.*")
    return single.unionByName(repeated)
