"""cadenza: speech-assessment data engineering as PySpark DataFrame jobs."""
