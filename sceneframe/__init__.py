"""Scene-state analytics as Spark jobs: every operator is DataFrame -> DataFrame or Column -> Column."""
