"""Job-posting and application-tracker analytics as Spark DataFrame operators."""
