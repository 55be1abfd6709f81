"""Table operators: upsert, history, quality rules, marts, churn."""
