"""Queries take all rows: small tables that are larger than a cut would be."""

from memlake.plans import knowledge


def test_relation_expand_takes_every_customer(spark, tmp_path):
    customers = [(k, (k + 1) % 25) for k in range(1, 301)]
    nations = [(n, n % 5) for n in range(25)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(nations, "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    got = sorted((r.query_id, r.id) for r in knowledge.relation_expand(spark, str(tmp_path)).collect())
    want = {(c, n) for c, n in customers} | {(c, n) for c, _ in customers for n, r in nations if r == c % 5}
    assert got == sorted((c, n) for c, n in want if n % 7)
