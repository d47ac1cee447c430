"""Analytics over collections of submitted texts and code, written as Spark DataFrame jobs."""
