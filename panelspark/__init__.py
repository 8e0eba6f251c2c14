"""Entity-panel analytics as DataFrame -> DataFrame operators on Spark."""
