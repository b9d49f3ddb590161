"""State machines of the stateful operators, without Spark: batch and streaming run the same code."""
