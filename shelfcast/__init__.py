"""Demand forecasting, basket analysis and credit scoring as Spark jobs."""
