"""scriptorium: a PySpark-native engine for multilingual document analytics."""
