"""Compare a query with its SQL, as rows with sorted column names."""

import duckdb


def duck(sf_dir, sql):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        g = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{g}'")
    return c.execute(sql).fetch_df()


def rows(df):
    df = df[sorted(df.columns)]
    out = [tuple(None if x != x else x for x in r) for r in df.itertuples(index=False)]
    return sorted(out, key=lambda r: [(x is None, 0 if x is None else x) for x in r])
