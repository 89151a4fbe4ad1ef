"""Hardware-design data engine on Spark."""
