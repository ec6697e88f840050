"""Analytics over technical documents and the netlists extracted from them, as Spark jobs."""
