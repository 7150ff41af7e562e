"""Tessella: a Spark-native engine for building, cleaning, searching and analysing a corpus of scraped listings."""
