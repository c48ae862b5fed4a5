"""Scalar and array functions as column expressions (sections A, J and N of the survey)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "struct<lend:int,rend:int>"
SPACER = "???"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n:int, op:string>> of a CIGAR string."""
    text = r"(\d+)([MIDNSHP=X])"
    return F.zip_with(F.regexp_extract_all(cigar, F.lit(text), F.lit(1)), F.regexp_extract_all(cigar, F.lit(text), F.lit(2)), lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("op")))


def cigar_blocks(cigar: Column, pos: Column) -> Column:
    """A2: reference blocks (1-based, closed) of M, =, X and D operations; N skips, I, S, H and P stand still."""
    none = F.expr(f"CAST(array() AS array<{SEGMENT}>)")

    def step(acc: Column, o: Column) -> Column:
        moves = o["op"].isin("M", "=", "X", "D", "N")
        end = acc["at"] + F.when(moves, o["n"]).otherwise(0)
        one = F.struct(acc["at"].cast("int").alias("lend"), (end - 1).cast("int").alias("rend"))
        return F.struct(end.cast("int").alias("at"), F.when(o["op"].isin("M", "=", "X", "D"), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), F.struct(pos.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def merge_sorted(blocks: Column, gap: int = 10) -> Column:
    """Sorted blocks joined where the next starts less than ``gap`` after the end of the last."""
    none = F.expr(f"CAST(array() AS array<{SEGMENT}>)")

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lend"].alias("lend"), F.greatest(last["rend"], b["rend"]).alias("rend"))))
        return F.when((F.size(acc) > 0) & (b["lend"] - F.get(acc, F.size(acc) - 1)["rend"] < gap), joined).otherwise(F.concat(acc, F.array(b)))

    def safe(acc: Column, b: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(b)).otherwise(step(acc, b))

    return F.aggregate(blocks, none, safe)


def cigar_segments(cigar: Column, pos: Column, gap: int = 10) -> Column:
    """A2, A3: exon segments of an alignment."""
    return merge_sorted(cigar_blocks(cigar, pos), gap)


def introns_of(segments: Column) -> Column:
    """A4: gaps between consecutive segments."""

    def gaps(x: Column) -> Column:
        n = F.size(x)
        rest = F.greatest(n - 1, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), rest), F.slice(x, F.lit(2), rest), lambda a, b: F.struct((a["rend"] + 1).alias("lend"), (b["lend"] - 1).alias("rend")))

    return bind(segments, gaps)


def total_length(segments: Column) -> Column:
    """Bases of all segments."""
    return F.aggregate(segments, F.lit(0), lambda a, e: a + e["rend"] - e["lend"] + 1)


def percent_identity(cigar: Column, nm: Column) -> Column:
    """100 - nm / aligned * 100, aligned being the M bases, or = and X where there is no M."""

    def bases(*ops: str) -> Column:
        return F.aggregate(F.filter(cigar_ops(cigar), lambda o: o["op"].isin(*ops)), F.lit(0), lambda a, o: a + o["n"])

    aligned = F.when(bases("M") > 0, bases("M")).otherwise(bases("=", "X"))
    return F.when(aligned > 0, 100.0 - nm / aligned * 100.0)


def soft_clips(cigar: Column) -> tuple[Column, Column]:
    """Left and right soft-clip lengths."""
    left, right = F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1), F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1)
    return F.coalesce(left.try_cast("int"), F.lit(0)), F.coalesce(right.try_cast("int"), F.lit(0))


def is_poly(sequence: Column, base: str = "A", *, least: int = 7, share: float = 0.8) -> Column:
    """A clipped end of ``least`` bases or more, of which ``share`` are ``base``."""
    return (F.length(sequence) >= least) & (F.length(F.regexp_replace(F.upper(sequence), f"[^{base}]", "")) >= share * F.length(sequence))


def splice_class(donor: Column, acceptor: Column) -> Column:
    """+ for GT-AG, GC-AG and AT-AC, - for their reverse complements, else null."""
    pair = F.concat(donor, F.lit("-"), acceptor)
    return F.when(pair.isin("GT-AG", "GC-AG", "AT-AC"), "+").when(pair.isin("CT-AC", "CT-GC", "GT-AT"), "-")


def reverse_complement(sequence: Column) -> Column:
    """K8: of a nucleotide string."""
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def intron_string(contig: Column, strand: Column, introns: Column) -> Column:
    """``contig:(strand)[(l, r), ...]``."""
    pairs = F.transform(introns, lambda i: F.concat(F.lit("("), i["lend"].cast("string"), F.lit(", "), i["rend"].cast("string"), F.lit(")")))
    return F.concat(contig, F.lit(":("), strand, F.lit(")["), F.array_join(pairs, ", "), F.lit("]"))


def exon_string(segments: Column) -> Column:
    """``[[a, b], ...]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(segments, lambda e: F.concat(F.lit("["), e["lend"].cast("string"), F.lit(", "), e["rend"].cast("string"), F.lit("]"))), ", "), F.lit("]"))


@F.pandas_udf(T.StringType())
def splice_hash(chains: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE2s with an 11-byte digest, as hex; call it once for each distinct chain."""
    for s in chains:
        yield s.map(lambda x: None if x is None else hashlib.blake2s(x.encode(), digest_size=11).hexdigest())


def sig_figs(x: Column, n: int) -> Column:
    """Rounded to ``n`` significant figures."""
    scale = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def safe_token(x: Column) -> Column:
    """Other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")


def number_or(x: Column, kind: str, default: object) -> Column:
    """The number in a text, or ``default``."""
    return F.coalesce(F.trim(x).try_cast(kind), F.lit(default).cast(kind))


def stable_digest(*cols: Column) -> Column:
    """Digest of a structure."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def contains_path(a: Column, b: Column) -> Column:
    """B stands in a from the place of b's first node on."""
    k = F.array_position(a, F.get(b, F.lit(0))).cast("int")
    return F.when((F.size(b) > 0) & (k > 0), F.slice(a, F.greatest(k, F.lit(1)), F.size(b)) == b).otherwise(False)


def compatible_paths(a: Column, b: Column) -> Column:
    """The first node that both share starts one of them, and they are equal until one ends; a spacer there fails."""
    i, j = F.array_position(a, F.get(b, F.lit(0))).cast("int"), F.array_position(b, F.get(a, F.lit(0))).cast("int")

    def same(x: Column, k: Column, y: Column) -> Column:
        n = F.least(F.size(x) - k + 1, F.size(y))
        s = F.slice(x, F.greatest(k, F.lit(1)), F.greatest(n, F.lit(0)))
        return (s == F.slice(y, F.lit(1), F.greatest(n, F.lit(0)))) & ~F.array_contains(s, SPACER)

    return F.when(i > 0, same(a, i, b)).when(j > 0, same(b, j, a)).otherwise(False)


def merge_paths(a: Column, b: Column) -> Column:
    """Compatible paths as one, from the earlier start to the later end; null if they aren't compatible."""
    i, j = F.array_position(a, F.get(b, F.lit(0))).cast("int"), F.array_position(b, F.get(a, F.lit(0))).cast("int")

    def joined(x: Column, k: Column, y: Column) -> Column:
        return F.when(F.size(x) - k + 1 >= F.size(y), x).otherwise(F.concat(F.slice(x, F.lit(1), F.greatest(k - 1, F.lit(0))), y))

    return F.when(compatible_paths(a, b), F.when(i > 0, joined(a, i, b)).otherwise(joined(b, j, a)))


def consecutive_in(part: Column, whole: Column) -> Column:
    """All of ``part`` in ``whole`` one after the other."""
    return contains_path(whole, part)


def trim_spacers(path: Column) -> Column:
    """Without spacers at either end."""
    first = F.array_position(F.transform(path, lambda x: x != SPACER), F.lit(True)).cast("int")
    last = F.array_position(F.reverse(F.transform(path, lambda x: x != SPACER)), F.lit(True)).cast("int")
    return F.when(first > 0, F.slice(path, F.greatest(first, F.lit(1)), F.size(path) - first - last + 2)).otherwise(F.slice(path, 1, 0))


def split_spacers(path: Column) -> Column:
    """The stretches between spacers."""
    return F.filter(F.transform(F.split(F.array_join(path, "\x1f"), "(?:^|\x1f)(?:\\?\\?\\?(?:\x1f|$))+"), lambda x: F.split(x, "\x1f")), lambda x: (F.size(x) > 0) & (F.get(x, F.lit(0)) != ""))


def trim_boundaries(path: Column) -> Column:
    """Without TSS and PolyA nodes."""
    return F.filter(path, lambda x: ~(x.startswith("TSS:") | x.startswith("POLYA:")))


def remove_spacers(path: Column) -> Column:
    """Without any spacer."""
    return F.filter(path, lambda x: x != SPACER)


def gapped_match(pattern: Column, path: Column) -> Column:
    """Whether ``path`` holds the nodes of ``pattern`` one after the other, with any nodes where it has a spacer."""
    nodes = F.transform(pattern, lambda x: F.when(x == SPACER, F.lit("(?:[^\x1f]*\x1f)*")).otherwise(F.concat(F.lit("\\Q"), x, F.lit("\\E\x1f"))))
    return (F.size(pattern) > 0) & F.rlike(F.concat(F.lit("\x1f"), F.array_join(path, "\x1f"), F.lit("\x1f")), F.concat(F.lit("\x1f"), F.array_join(nodes, "")))


def spans_overlap(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Whether two paths' spans overlap, by strict comparison."""
    return (l1 < r2) & (r1 > l2)


def path_relation(a: Column, b: Column) -> Column:
    """What ``a`` is to ``b``: equal, contains, contained, compatible or incompatible."""
    return F.when(a == b, "equal").when(contains_path(a, b), "contains").when(contains_path(b, a), "contained").when(compatible_paths(a, b), "compatible").otherwise("incompatible")


def join_paths(a: Column, b: Column) -> Column:
    """Compatible paths as one; else both with a spacer between them where ``a`` ends before ``b``; else the longer."""
    apart = F.element_at(a, -1) < F.get(b, F.lit(0))
    return F.coalesce(merge_paths(a, b), F.when(apart, F.concat(a, F.array(F.lit(SPACER)), b)), F.when(F.size(a) >= F.size(b), a).otherwise(b))


def read_key(name: Column) -> Column:
    """A numeric name as its number, else the first 16 hex digits of its SHA-1 as a number."""
    number = F.when(name.rlike("^[0-9]{1,18}$"), name.cast("decimal(20,0)"))
    return F.coalesce(number, F.conv(F.substring(F.sha1(name), 1, 16), 16, 10).cast("decimal(20,0)"))


def alignment_score(tag: Column, aligned: Column, nm: Column) -> Column:
    """The score tag, or aligned bases less the mismatches."""
    return F.coalesce(tag, aligned - F.coalesce(nm, F.lit(0)))
