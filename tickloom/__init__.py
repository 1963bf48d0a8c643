"""Order-book analytics on PySpark."""
