"""Regional risk analytics as plain DataFrame -> DataFrame functions on Spark."""
