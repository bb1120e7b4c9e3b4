from pointloom.llm._util import BATCH_BYTES, BATCH_ROWS, in_small_batches


def test_batches_are_bounded_but_never_raised(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for given, want in ((None, BATCH_ROWS), ("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("50", 50)):
            spark.conf.unset(rows) if given is None else spark.conf.set(rows, given)
            in_small_batches(spark.range(1))
            assert int(spark.conf.get(rows)) == want
        for given, want in ((None, BATCH_BYTES), ("64m", BATCH_BYTES), ("1048576b", 1048576)):
            spark.conf.unset(size) if given is None else spark.conf.set(size, given)
            in_small_batches(spark.range(1))
            assert int(spark.conf.get(size).rstrip("b")) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
