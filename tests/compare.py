"""Run registered queries next to their SQL and compare rows, as the correctness gate does."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, int):
        return v
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    pick = lambda rows, cols: sorted(
        (tuple(norm(r[i]) for i in sorted(range(len(cols)), key=lambda j: cols[j])) for r in rows), key=repr)
    a, b = pick(spark_rows, spark_cols), pick(duck_rows, duck_cols)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; spark {a[:2]} duck {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference\n   spark {x}\n   duck  {y}\n   of {len(a)} rows"
    return None


def check(spark, sf_dir, con, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    if sql is None:
        return None, len(rows), t1 - t0, 0.0, dict(df.dtypes)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    duck = res.fetchall()
    problem = compare([tuple(r) for r in rows], df.columns, duck, cols)
    same = {"bigint": {"BIGINT", "NUMBER"}, "int": {"INTEGER", "NUMBER"}}
    odd = {c: (t, types[c]) for c, t in df.dtypes if c in types and t in ("bigint", "int")
           and types[c] not in same[t]}
    if odd and not problem:
        problem = f"types {odd}"
    return problem, len(rows), t1 - t0, time.time() - t1, None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from callgrove.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    d = sf if "/" in sf else f"/root/testdata/sf{sf}"
    con, sqls, bad, total = connect(d), entry.oracle_sql(), 0, 0.0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            problem, n, s, q, _ = check(spark, d, con, name, fn, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            problem, n, s, q = f"{type(e).__name__}: {str(e)[:400]}", -1, 0, 0
        total += s
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} spark={s:.2f}s duck={q:.2f}s"
              + (" (no sql)" if name not in sqls else "") + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"bad={bad} spark total={total:.1f}s")
