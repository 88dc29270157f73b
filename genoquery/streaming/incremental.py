"""New accessions as a stream: each micro-batch is compared with the reference set and with itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from genoquery.operators.pairs import similar_pairs
from genoquery.sources.matrix import with_reference


def find_duplicates(stream: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], max_distance: float = 0.2):
    """A stream writer whose batches of genotypes (whole accessions) go through the reference-set join; sink gets the pairs and the batch's number. A batch that is repeated after a failure gives the same pairs, so a sink that overwrites by number is exactly-once."""

    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(similar_pairs(with_reference(reference, batch), max_distance), number)

    return stream.writeStream.foreachBatch(handle)
