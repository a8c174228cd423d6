"""parcelry: a PySpark-native engine for territory, entity-attribution and ledger analytics."""
