"""factloom: code facts and training-data operators on Spark."""
