"""Training-data operations as Spark DataFrame functions."""
