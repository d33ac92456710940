"""quillmesh: event-sourced media catalog analytics on Spark DataFrames."""
