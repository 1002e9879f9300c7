"""Feature vectors of articles as they arrive.

The feature functions look at one row only, so a stream needs no state and no watermark: each micro-batch is a scan,
a projection and an append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import preprocess
from ..plans.features import FeatureConfig, local_features


def stream_features(articles: DataFrame, config: FeatureConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Write the local features of a stream as Parquet, each article once; stops when the input is used up."""
    features = local_features(preprocess(articles), config)
    return (
        features.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
