"""plenarium: civic-record analytics and training-data preparation on PySpark."""
