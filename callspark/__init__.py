"""callspark: call-centre analytics as PySpark DataFrame jobs."""
