"""Compare every query with its SQL on one scale factor (not a pytest module).

    python tests/check_oracles.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf):
    """Rows as sorted tuples of plain text, columns by name."""
    out = []
    for row in pdf[sorted(pdf.columns)].itertuples(index=False):
        out.append(tuple("NULL" if _missing(v) else _text(v) for v in row))
    return sorted(out)


def _missing(v):
    return v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>")


def _text(v):
    if isinstance(v, float):
        return repr(float(v))
    return str(v)[:10] if str(v).endswith(" 00:00:00") else str(v)


def compare(spark, con, name, sf_dir):
    started = time.time()
    got = queries()[name](spark, sf_dir).toPandas()
    took = time.time() - started
    if name not in oracle_sql():
        return got, None, took, len(got) > 0
    want = con.sql(oracle_sql()[name]).df()
    same = sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
    return got, want, took, same


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    failed = []
    for name in argv[2:] or queries():
        try:
            got, want, took, same = compare(spark, con, name, sf_dir)
        except Exception as exc:
            print(f"{name}: ERROR {str(exc)[:1500]}", flush=True)
            failed.append(name)
            continue
        print(f"{name}: rows {len(got)} {'-' if want is None else len(want)} {took:.1f}s {'ok' if same else 'DIFFER'}", flush=True)
        if not same:
            failed.append(name)
            if want is not None:
                print(got.dtypes.to_dict(), want.dtypes.to_dict())
                a, b = canonical(got), canonical(want)
                print([r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3])
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv)
