"""wakeflow: moving-object analytics as Spark DataFrame transformations."""
