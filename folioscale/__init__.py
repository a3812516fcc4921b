"""folioscale: extraction, cleaning, ranking and journal operators for web text on PySpark."""

__version__ = "0.1.0"
