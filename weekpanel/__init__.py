"""weekpanel: regional weekly panels from short user-written messages, as Spark DataFrame operators."""
