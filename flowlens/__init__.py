"""flowlens: packet and flow analytics, and corpus preparation, on Spark."""
