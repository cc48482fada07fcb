"""The bitmap of texts whose sets are built a second time: what reaches the driver, and that it is right."""

import numpy as np
import pytest

from provspark.llm import jaccard


@pytest.mark.parametrize("partitions", [1, 7])
def test_bitmap_reaches_the_driver_in_few_values(spark, monkeypatch, partitions):
    rng = np.random.default_rng(2)
    hashes = [0, -1, 63, 64, jaccard.PAGE - 1, jaccard.PAGE, jaccard.BITS - 1, jaccard.BITS] + [int(h) for h in rng.integers(-2**63, 2**63 - 1, 20_000, dtype=np.int64)]
    df = spark.createDataFrame([(h,) for h in hashes + hashes[:50]], "t64 long").repartition(partitions)
    collected, kind = [], type(df)
    whole = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: collected.append(whole(self)) or collected[-1])
    bitmap = jaccard.text_bitmap(df)
    want = np.zeros(jaccard.BITS, np.uint8)
    want[np.array(hashes, np.int64) & (jaccard.BITS - 1)] = 1
    assert (bitmap == np.packbits(want, bitorder="little")).all()
    assert sum(map(len, collected)) <= jaccard.BITS // jaccard.PAGE


def test_bitmap_of_no_texts(spark):
    assert not jaccard.text_bitmap(spark.createDataFrame([], "t64 long")).any()
