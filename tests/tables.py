"""Variants of the smallest test tables: empty ones, and ones with nulls in every column and columns of clashing names."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
CLASHES = ("key", "block", "n", "score", "rank", "words", "line", "w", "a", "b", "grams", "_g", "_n")


def write(kind: str, out: str) -> str:
    os.makedirs(out, exist_ok=True)
    for p in glob.glob(f"{SF}/*.parquet"):
        t = pq.read_table(p)
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            schema = pa.schema([pa.field(f.name, f.type) for f in t.schema])
            t = t.cast(schema)
            nulled = [t.slice(k, 1).set_column(k, schema.field(k), pa.nulls(1, schema.field(k).type)) for k in range(min(len(schema), t.num_rows))]
            t = pa.concat_tables([t, pa.table({f.name: pa.nulls(2, f.type) for f in schema}, schema=schema), *nulled])
            for c in CLASHES:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["clash"] * t.num_rows))
        pq.write_table(t, f"{out}/{os.path.basename(p)}")
    return out


def duck_tables(sf: str = SF):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    return str(v)


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_plain(row[i]) for i in at) for row in r.fetchall())
    assert sorted(tuple(_plain(v) for v in row) for row in df.select(*cols).collect()) == want
