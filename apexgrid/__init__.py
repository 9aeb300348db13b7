"""Vehicle-logger telemetry analytics on Spark DataFrames.

One logged run is a *session*; a session holds *channels*, evenly sampled series with their own rate.
``samples(session_id, channel, freq, sample_idx, value)`` is the central table, one row per sample.
"""

__version__ = "0.1.0"
