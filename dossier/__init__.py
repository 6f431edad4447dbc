"""A PySpark-native engine for analysing corporate regulatory filings."""
