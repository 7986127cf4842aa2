"""fieldpulse: Spark-native analytics for farm sensor reading streams.

Every operator is a pure ``DataFrame -> DataFrame`` function built from
built-in Spark SQL expressions, usable on static and streaming frames.
"""

__version__ = "0.1.0"
