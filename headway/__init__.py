"""headway: transit demand analytics and training-data preparation on PySpark."""
