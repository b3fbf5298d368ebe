"""Programs in rows that are bounded, whatever the size of the whole."""

from pyspark.sql import functions as F

from speechlab.operators import programs as R


def test_program_in_parts(spark):
    """A row for each activity, whatever the size of a module; places are those of the whole program, also by far orders."""
    rows = [("m" + str(a % 2), "s" + str(a % 4), f"a{a}", "t", f"e{a}-{e}", "x", {"k": str(p)}, (97 - a) * 10**11 + e * 10 + p) for a in range(40) for e in range(3) for p in range(2)]
    schema = "module string, set string, activity string, type string, exercise string, aspect string, phrase map<string,string>, o long"
    nested = R.nest_program(spark.createDataFrame(rows, schema), "o")
    assert nested.count() == 40
    assert nested.select(F.max(F.size("modules")), F.max(F.size(F.col("modules")[0]["sets"][0]["activities"]))).first() == (1, 1)
    flat = R.flatten_program(nested).collect()
    assert len(flat) == len(rows)
    # later activities come first: their orders are smaller
    want = {}
    for a in range(40):
        m, s = a % 2, a % 4
        place = sorted((b for b in range(40) if b % 4 == s), reverse=True).index(a)
        for e in range(3):
            for p in range(2):
                want[f"e{a}-{e}", str(p)] = (1 - m, 0 if s >= 2 else 1, place, e, p)
    assert {(r["exercise"], r["phrase"]["k"]): (r["o_module"], r["o_set"], r["o_activity"], r["o_exercise"], r["o_phrase"]) for r in flat} == want


def test_program_with_empty_levels(spark):
    rows = [("m", "s", "a", "t", None, None, None, 1), ("m", "z", None, None, None, None, None, 2), ("n", None, None, None, None, None, None, 3), ("m", "s", "b", "t", "e", "x", None, 4)]
    schema = "module string, set string, activity string, type string, exercise string, aspect string, phrase map<string,string>, o long"
    flat = R.flatten_program(R.nest_program(spark.createDataFrame(rows, schema), "o"))
    got = {tuple(r) for r in flat.select("module", "set", "activity", "exercise", "aspect", "phrase", "o_module", "o_set", "o_activity").collect()}
    assert got == {("m", "s", "a", None, None, None, 0, 0, 0), ("m", "z", None, None, None, None, 0, 1, None), ("n", None, None, None, None, None, 1, None, None), ("m", "s", "b", "e", "x", None, 0, 0, 1)}


def test_program_rows_are_bounded(spark):
    """No row of the program of regions holds more than one customer."""
    from speechlab.catalogue_evaluation import _program

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    most = _program(*map(read, ("region", "nation", "customer", "orders", "lineitem"))).select(F.explode("modules").alias("m")).select(F.explode("m.sets").alias("s")).agg(F.max(F.size("s.activities"))).first()[0]
    assert most == 1
