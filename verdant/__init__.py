"""Spark-native harmonisation and analytics of occurrence-record catalogs and site registries."""
