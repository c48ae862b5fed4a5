"""Registered queries against their SQL in DuckDB, on a small generated star schema."""

import datetime as dt
import math
import random

import duckdb
import pandas as pd
import pytest

from isoweave.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    r = random.Random(1)
    folder = tmp_path_factory.mktemp("sf")
    day = lambda: dt.datetime(1995, 1, 1) + dt.timedelta(seconds=r.randrange(10**6))
    seen, line = set(), []
    while len(line) < 1500:
        key = (r.randrange(400), r.randrange(1, 201), r.randrange(1, 41), r.randrange(1, 8))
        if key not in seen:
            seen.add(key)
            line.append((*key[:3], key[3], float(r.randrange(1, 50)), round(r.uniform(900, 9000), 2), round(r.randrange(11) / 100, 2), round(r.randrange(9) / 100, 2), r.choice("ANR"), r.choice("OF"), day()))
    frames = {
        "lineitem": pd.DataFrame(line, columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()).astype({"l_linenumber": "int32"}),
        "orders": pd.DataFrame([(i, r.randrange(50), r.choice("OFP"), round(r.uniform(1000, 9000), 2), day(), "1") for i in range(400)], columns="o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()),
        "part": pd.DataFrame([(i, f"part {i} x/y", "b", "t", r.randrange(1, 50), round(r.uniform(900, 2000), 2)) for i in range(1, 201)], columns="p_partkey p_name p_brand p_type p_size p_retailprice".split()).astype({"p_size": "int32"}),
        "customer": pd.DataFrame([(i, "c", r.randrange(25), round(r.uniform(9000, 9999), 2), "m") for i in range(100)], columns="c_custkey c_name c_nationkey c_acctbal c_mktsegment".split()).astype({"c_nationkey": "int32"}),
        "nation": pd.DataFrame([(i, f"NATION_{i}", i % 5) for i in range(25)], columns="n_nationkey n_name n_regionkey".split()).astype({"n_nationkey": "int32", "n_regionkey": "int32"}),
        "region": pd.DataFrame([(i, f"REGION_{i}") for i in range(5)], columns="r_regionkey r_name".split()).astype({"r_regionkey": "int32"}),
        "supplier": pd.DataFrame([(i, f"s {i}", r.randrange(25), round(r.uniform(0, 9999), 2)) for i in range(40)], columns="s_suppkey s_name s_nationkey s_acctbal".split()).astype({"s_nationkey": "int32"}),
        "events": pd.DataFrame([(i, day(), r.randrange(80), r.choice(["view", "buy", "click"]), r.random(), "{}") for i in range(1000)], columns="event_id ts user_id event_type value props".split()),
    }
    con = duckdb.connect()
    for name, f in frames.items():
        con.register("f", f)
        cols = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" if c in ("ts", "l_shipdate", "o_orderdate") else c for c in f.columns)
        con.execute(f"COPY (SELECT {cols} FROM f) TO '{folder}/{name}.parquet' (FORMAT PARQUET)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


def text(v):
    return "None" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.4f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    folder, con = tables
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    rows = df.collect()
    assert len(set(cols)) == len(cols)
    if name not in ORACLE_SQL:
        assert rows
        return
    r = con.execute(ORACLE_SQL[name])
    own = [d[0] for d in r.description]
    assert sorted(own) == cols
    want = sorted(tuple(text(x[own.index(c)]) for c in cols) for x in r.fetchall())
    got = sorted(tuple(text(x[c]) for c in cols) for x in rows)
    assert len(got) == len(want)
    assert got == want
