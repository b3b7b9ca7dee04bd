"""terrane: a Spark-native engine for cleaning, encoding, modelling and scoring wide, messy tables."""

__version__ = "0.1.0"
