from marketlens.llm import neighbours
from marketlens.llm.shared import Scratch


def test_repeated_query_row_keeps_all_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = neighbours.nearest(Scratch(spark, "t"), df.unionByName(df.where("vec_id = 20"))).where("query_id = 20").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21))
    assert len({r.vec_id for r in got}) >= 19
