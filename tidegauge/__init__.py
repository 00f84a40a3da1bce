"""tidegauge: a Spark engine for building trading strategies and doubting them."""

__version__ = "0.1.0"
