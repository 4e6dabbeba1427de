"""Query debugging and testing on stock Spark: lineage, decomposition, influence, isolation,
watchpoints, profiling, reuse, fuzzing and test generation over ordinary DataFrames."""
