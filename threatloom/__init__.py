"""threatloom: spam, phishing and threat analytics as PySpark DataFrame operators."""
