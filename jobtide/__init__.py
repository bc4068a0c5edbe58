"""Posting analytics on Spark: pages to records, records to history, history to answers."""
