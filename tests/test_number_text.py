"""Balances of any size and sign give the root that the SQL of id_parse has."""

import random
import struct

import duckdb

from seqloom.functions import sequences as S
from seqloom.plans import catalog


def test_id_parse_equals_sql_on_odd_balances(spark, tmp_path):
    rnd = random.Random(3)
    odd = [0.0, -0.0, -0.004, -0.5, 999.999, 0.001, 1e-4, 1e-5, -1e-5, 1.5e-7, 1e7, 123456789.125, 1e11, 1e15, 9007199254740994.0, 1e16, 1e17, 1.5e22, 1e300, 1.5e300, float("nan"), float("inf"), float("-inf"), None]
    odd += [round(rnd.uniform(-1, 1), 2) for _ in range(100)] + [struct.unpack("d", rnd.randbytes(8))[0] for _ in range(300)]
    odd += [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-6, 18) for _ in range(300)]
    rows = [(i, f"Customer#{i:09d}", x, "BUILDING") for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")
    df.write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql("SELECT id, first_part, tax, query_id, root, prefix FROM (" + catalog.SQL["id_parse"] + ")").fetchall()}
    got = {r["id"]: tuple(r[c] for c in ("id", "first_part", "tax", "query_id", "root", "prefix")) for r in catalog.id_parse(spark, str(tmp_path)).collect()}
    assert {i: (odd[i], got[i][4], want[i][4]) for i in want if got[i] != want[i]} == {}
    texts = {r[0]: r[1] for r in con.sql("SELECT c_custkey, c_acctbal::VARCHAR FROM customer").fetchall()}
    written = {r[0]: r[1] for r in df.select("c_custkey", S.number_text(df["c_acctbal"])).collect()}
    plain = [i for i, x in enumerate(odd) if x is not None and abs(x) < 1e16]
    assert {i: (written[i], texts[i]) for i in plain if written[i] != texts[i] and float(written[i]) != float(texts[i])} == {}
