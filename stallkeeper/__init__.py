"""Marketplace analytics on PySpark: cleaning, star schema, governed marts, checks and churn scoring."""
