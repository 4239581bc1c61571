"""Analytics for model-routing datasets on Spark."""
