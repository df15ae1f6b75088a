"""finsift: a PySpark-native engine for financial-fraud analytics and corpus preparation."""
