"""millrace: versioned tables, crawl and metric dataflows and streaming on PySpark."""
