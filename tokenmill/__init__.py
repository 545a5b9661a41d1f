"""tokenmill: Spark-native preparation, assembly and scoring of speech-token corpora.

Every public operator is a plain ``DataFrame -> DataFrame`` function built on
Spark SQL expressions, joins, windows and aggregates; the few per-row Python
steps (WAV decoding, user encoders, nearest-centroid search, raw int64 blobs)
run as Arrow-batched ``mapInPandas`` jobs.
"""

__version__ = "0.1.0"
