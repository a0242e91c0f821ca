"""Property checks: positions are dense and ordered, ranks match pandas, for random layouts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barspark.operators.ordering import global_position, release_positions, with_key_rank

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "hot", None]), st.integers(0, 50)),
                min_size=1, max_size=300)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 9), block=st.sampled_from([4, 16, 1 << 20]))
def test_positions_and_ranks(spark, data, parts, block):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        data = [(k, t, i) for i, (k, t) in enumerate(data)]  # i: unique tie-breaker
        df = spark.createDataFrame(data, "key string, t long, i long").repartition(3)
        g = global_position(df, ["key", "t", "i"]).toPandas()
        assert sorted(g["_g"]) == list(range(len(data)))
        srt = g.sort_values("_g")
        keyed = srt.assign(k0=srt["key"].isna(), k1=srt["key"].fillna(""))
        assert keyed[["k0", "k1", "t", "i"]].apply(tuple, axis=1).tolist() == sorted(
            keyed[["k0", "k1", "t", "i"]].apply(tuple, axis=1).tolist(), key=lambda x: (not x[0], x[1], x[2], x[3]))
        r = with_key_rank(df, ["key"], ["t", "i"], block_rows=block).toPandas()
        pdf = g[g["key"].notna()].sort_values(["key", "t", "i"])
        pdf = pdf.assign(rank=pdf.groupby("key").cumcount(), n=pdf.groupby("key")["i"].transform("size"))
        m = pdf.merge(r, on=["key", "t", "i"])
        assert len(m) == len(pdf) == len(r)
        assert (m["rank"] == m["_r"]).all() and (m["n"] == m["_n"]).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        release_positions()
