"""Classification of sequences that arrive as a stream, against a static reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sequora.operators import neighbours as N


def classify(queries: DataFrame, reference: DataFrame, n_sites: int, k: int = 3, weight: str = "w") -> DataFrame:
    """(q, pred, support): the winning taxon of each query. Both: (seq, codes); the reference has a taxon too."""
    taxa = reference.select(F.col("seq").alias("r"), "taxon")
    near = N.neighbours(N.distances(queries, reference, n_sites, loo=False), k).join(taxa, "r")
    return N.winner(N.support(near, ["q"], "taxon"), ["q"], "taxon", weight)


def classify_stream(queries: DataFrame, reference: DataFrame, n_sites: int, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 3, **trigger) -> StreamingQuery:
    """Hands every micro-batch's calls and its number to the sink; a number that comes again replaces what it wrote.

    No state is kept between batches, so late rows need no watermark.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(classify(rows, reference, n_sites, k), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
