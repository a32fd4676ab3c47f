"""Compare rows of two engines: columns by name, rows in any order, floats to nine digits."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duckdb_rows(sf, sql):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(sql)
    return sorted_rows([d[0] for d in r.description], r.fetchall())


def spark_rows(df):
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)

    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)
