"""Steps get a bounded number of rows at once, so that their arrays do not grow with the partitions."""

import pyarrow as pa

from maskmix.functions import kernels as K
from maskmix.functions.runtime import BATCH_ROWS, map_arrow


def test_steps_get_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([sum(batch.column(0).to_pylist())])], names=["n", "total"])

    got = map_arrow(spark.range(0, 9000, 1, 1), sizes, "n long, total long").collect()
    assert max(r.n for r in got) <= BATCH_ROWS and sum(r.n for r in got) == 9000
    assert sum(r.total for r in got) == sum(range(9000))


def test_lists_of_a_piece_are_its_own(spark):
    def firsts(batches):
        for batch in batches:
            values = K.matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values[:, 0])], names=["id", "v"])

    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "array(double(id), 1D) AS x")
    assert all(r.id == r.v for r in map_arrow(rows, firsts, "id long, v double").collect())
