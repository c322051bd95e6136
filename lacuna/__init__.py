"""Missing-data mechanisms on Spark: preparation, simulation, profiles, tests, diagnosis, evaluation."""
