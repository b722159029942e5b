"""Small-side joins whose size is checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.session import materialise

# A lookup within both bounds is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20


def bounded_lookup(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, stored: bool = False
) -> DataFrame:
    """``df`` as a broadcastable local relation if it has at most ``max_rows`` rows and ``max_bytes``, else as a table.

    Reads at most ``max_rows + 1`` rows to the driver. The local form is computed once, so a plan that joins the
    lookup does not run its aggregation again. Beyond the bounds it is written to the shared folder once and joined by
    shuffle, with AQE splitting hot keys. ``stored`` says that ``df`` is such a table already, so that it is only read.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df if stored else materialise(df, "lookup")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
