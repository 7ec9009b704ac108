"""Web-data and price intelligence as Spark DataFrame operators."""
