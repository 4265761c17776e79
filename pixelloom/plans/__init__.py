"""Jobs made of several operators: answers, batch prediction, fetch planning."""
