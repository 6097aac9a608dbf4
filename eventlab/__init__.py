"""eventlab: synthesize, route, correlate and observe event data with Spark."""
