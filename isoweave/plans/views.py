"""Projections of the star-schema tables into the library's model; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> SQL over tables and earlier views.
VIEWS: dict[str, str] = {
    "tracking": "SELECT DISTINCT l_suppkey % 10 AS gene_id, l_suppkey AS tx_id, l_orderkey AS read_id, l_orderkey % 50 AS cell FROM lineitem",
    "pieces": "SELECT l_returnflag AS contig, l_linestatus AS strand, l_partkey * 10 + l_linenumber AS lend, l_partkey * 10 + l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS rend, l_orderkey AS read_id, l_suppkey AS tx_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS piece_id, l_tax AS tax FROM lineitem",
    # the annotated exons are what a high tax marks
    "exons": "SELECT DISTINCT contig, strand, lend, rend FROM pieces WHERE tax > 0.065",
    "cells": "SELECT DISTINCT l_orderkey % 50 AS cell, CASE WHEN l_orderkey % 50 < 20 THEN 'c0' WHEN l_orderkey % 50 < 35 THEN 'c1' ELSE 'c2' END AS cluster FROM lineitem",
    "usage": "SELECT l_suppkey % 10 AS gene_id, l_suppkey AS tx_id, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS count_a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS DOUBLE) AS count_b FROM lineitem GROUP BY l_suppkey",
    "clustered": "SELECT l_suppkey % 10 AS gene_id, l_suppkey AS tx_id, l_linestatus || l_returnflag AS cluster, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY l_suppkey, l_linestatus, l_returnflag",
    "alignments": "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS read_id, l_returnflag AS contig, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CAST(l_partkey AS INT) + 1 AS pos, CAST((l_orderkey % 16) * 256 % 4096 + (l_suppkey % 2) * 16 AS INT) AS flag, CAST(l_partkey % 60 AS INT) AS mapq, CAST(l_suppkey % 30 AS INT) AS nm, concat(CAST(l_linenumber AS INT), 'S', CAST(floor(l_quantity) AS INT) + 5, 'M', l_suppkey % 40 + 1, CASE WHEN l_partkey % 3 = 0 THEN 'D' ELSE 'N' END, l_partkey % 25 + 3, CASE WHEN l_partkey % 4 = 0 THEN '=' ELSE 'M' END, CASE WHEN l_orderkey % 2 = 0 THEN '2I4M' ELSE '' END) AS cigar FROM lineitem",
    "sites": "SELECT event_type AS contig, '+' AS strand, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS BIGINT) AS pos, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "genome": "SELECT contig, bin, translate(md5(concat_ws('-', contig, bin)), '0123456789abcdef', 'ACGTACGTACGTACGA') AS seq FROM (SELECT DISTINCT l_returnflag AS contig FROM lineitem) CROSS JOIN (SELECT DISTINCT CAST(floor(p_partkey / 32) AS BIGINT) + k AS bin FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6))",
    "isoforms": "SELECT l_orderkey AS tx_id, l_orderkey % 100 AS gene_id, count(*) AS n_reads, count(DISTINCT l_linenumber) AS n_exons, CAST(sum(floor(l_quantity)) AS BIGINT) AS length, max(l_tax) > 0.07 AS has_tss, min(l_discount) < 0.01 AS has_polya, min(l_linestatus) = 'O' AS is_ref, CAST(floor(sum(l_quantity) / 10) AS DOUBLE) AS tpm FROM lineitem GROUP BY l_orderkey",
    "chains": "SELECT DISTINCT l_orderkey AS tx_id, l_partkey AS intron FROM lineitem",
}


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)) - {"ts"}


def duck(sql: str) -> str:
    """``sql`` with the views that it needs before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if n in _names(text) and n not in need:
                add(VIEWS[n])
                if n not in need:
                    need.append(n)

    add(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    if not head:
        return sql
    body = sql.lstrip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE" if recursive else "WITH") :]
        return f"WITH {'RECURSIVE ' * recursive}{head}, {body}"
    return f"WITH {head} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table of ``sf_dir`` as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    tables = {n: view(spark, sf_dir, n) for n in _names(sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in tables else m[0], sql.replace("extract(hour FROM ts)", "hour(ts)").replace("extract(minute FROM ts)", "minute(ts)").replace("extract(second FROM ts)", "second(ts)")), **tables)
