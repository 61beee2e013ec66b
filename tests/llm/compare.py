"""Spark result against DuckDB SQL, as multisets of rows."""

import duckdb


def oracle_rows(sf_dir, sql, columns):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "pages", "conversations", "events"):
        import os

        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            src = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{src}')")
    names = ", ".join(columns)
    return sorted(con.sql(f"SELECT {names} FROM ({sql})").fetchall(), key=repr)


def same(df, sf_dir, sql):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = oracle_rows(sf_dir, sql, df.columns)
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
