"""A multimodal semantic query engine and record-processing library on Spark DataFrames."""
