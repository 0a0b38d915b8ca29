"""Analytics over software supply chain facts kept as tables, on Spark."""
