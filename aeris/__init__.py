"""aeris — air-quality analytics as plain Spark DataFrame transformations.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or a
``Column``) so it composes with ``df.transform``. Nothing here collects
data to the driver; the few driver-side decisions (CSV dialect probing,
first non-empty source) look at column names or a single row only.
"""

__version__ = "0.1.0"
