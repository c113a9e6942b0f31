"""pagelantern: audits whole corpora of web pages with PySpark DataFrames."""
