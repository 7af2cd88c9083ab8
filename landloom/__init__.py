"""landloom: regional-records analytics on Spark. Operators take and return DataFrames."""
