"""sparkloom: declarative preparation and profiling of conversation data on Spark."""

__version__ = "0.1.0"
