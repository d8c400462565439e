"""glossweave: entity-linking analytics as Spark DataFrame transformations."""
