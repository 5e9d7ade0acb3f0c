"""quernstone: DataFrame and Structured Streaming jobs for event and order analytics."""
