"""matchengine: document matching analytics as Spark DataFrame plans."""
