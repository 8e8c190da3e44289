"""Early-warning analytics on Spark: documents and scores to watchlists and their evaluation."""
