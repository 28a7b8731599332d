"""Registered queries: name to (spark, sf_dir) -> DataFrame, with the SQL that checks each."""
