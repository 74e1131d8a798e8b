"""gramlake: kernel analytics and training-data operators on PySpark DataFrames."""
