"""A PySpark-native engine for sequencing analytics: DataFrame operators, sources, functions, plans and streams."""
