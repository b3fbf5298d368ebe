"""SQL that states the rule of its query on any table."""

import duckdb

from speechlab import catalogue


def same_as_sql(spark, path, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    got = catalogue.queries()[name](spark, str(path))
    want = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = sorted(map(tuple, got.select(*names).collect()))
    assert rows and rows == sorted(want.fetchall())
    return rows


def test_shared_runs_of_uneven_recordings(spark, tmp_path):
    """Recordings of any number of frames, whose runs are not of 19 frames."""
    rows = [(v, [((v * 7 + k * 13) % 64) / 64 - 0.5 for k in range(12)], v % 10) for v in range(400) if v % 50 < 50 - v // 50 * 6 and v % 11]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    same_as_sql(spark, tmp_path, "k11_shared_runs", "embeddings")
    same_as_sql(spark, tmp_path, "k12_pooled_segments", "embeddings")


def test_pooled_halves(spark):
    """A mean on the border of two fifth digits is rounded up on both sides, in whatever order it was summed."""
    path = "/root/testdata/sf0.1"
    want = duckdb.connect()
    want.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    rows = {(r[0], r[1]): r[3] for r in want.execute(catalogue.oracle_sql()["k12_pooled_segments"]).fetchall()}
    got = {(r["rec_id"], r["pos"]): r["p_true"] for r in catalogue.queries()["k12_pooled_segments"](spark, path).collect()}
    assert got == rows


def test_numbers_over_a_million(spark, tmp_path):
    keys = [1, 999_999, 1_000_000, 1_000_001, 1_000_100, 1_200_345, 12_000_017, 999_999_999, 1_000_000_000, 2_000_000_019]
    spark.createDataFrame([(k, k) for k in keys], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    told = dict(same_as_sql(spark, tmp_path, "t6_number_words", "lineitem"))
    assert told["1200345"] == "one million, two hundred thousand, three hundred forty-five"
