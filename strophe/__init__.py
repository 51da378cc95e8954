"""strophe: analytics over ordered, keyed sequences on Spark."""
