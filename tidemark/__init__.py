"""tidemark: click-stream feature, scoring and monitoring operators for Spark.

Every operator takes a DataFrame and returns a DataFrame.  The few *fit*
operators that must look at data first (scaler, index maps, drift reference,
knots, models) return small artifacts and say so in their docstring.
"""

__version__ = "0.1.0"
