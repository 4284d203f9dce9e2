"""veilspark: language-model security analytics and training-data preparation on PySpark."""
