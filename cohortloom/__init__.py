"""Month-end customer and sales-agent analytics, written as Spark DataFrame transformations."""
