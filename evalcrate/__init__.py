"""evalcrate: prompt-dataset preparation and model-output evaluation as Spark jobs.

Every public function takes and returns ``pyspark.sql.DataFrame`` or
``pyspark.sql.Column`` objects; nothing is collected to the driver.
"""

__all__ = ["functions", "operators", "sources", "sinks", "plans", "streaming"]
