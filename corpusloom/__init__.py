"""Token-corpus engine on Spark: documents in, training-ready token batches out."""
