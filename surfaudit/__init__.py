"""Evidence auditing over surface score maps, as Spark DataFrame operators."""
