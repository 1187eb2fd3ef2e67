"""hazelake: hourly air-quality and fire analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
