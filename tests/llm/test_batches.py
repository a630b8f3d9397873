import pyarrow as pa

from evalframe.llm import batches


def test_the_rows_of_an_arrow_batch_are_limited_where_it_is_made(spark):
    before = spark.conf.get(batches.BATCH_ROWS)
    try:
        spark.conf.set(batches.BATCH_ROWS, "10000")
        docs = spark.range(4000).selectExpr("id", "repeat('x', 10) AS text").coalesce(1)
        lengths = lambda bs: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in bs)
        made = lambda: lambda texts: [pa.array([len(t) for t in texts], pa.int64())]
        got = batches.map_texts(docs, made, "size bigint", ["id"], rows=700)
        assert got.where("size = 10").count() == 4000
        assert max(r.n for r in docs.mapInArrow(lengths, "n long").collect()) <= 700
        # The session's own smaller limit stays.
        spark.conf.set(batches.BATCH_ROWS, "50")
        batches.map_texts(docs, made, "size bigint", ["id"], rows=700)
        assert spark.conf.get(batches.BATCH_ROWS) == "50"
    finally:
        spark.conf.set(batches.BATCH_ROWS, before)
