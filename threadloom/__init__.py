"""threadloom: conversation, document, embedding and source-code analytics on Spark DataFrames."""
