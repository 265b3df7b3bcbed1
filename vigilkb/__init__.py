"""vigilkb: consistency monitoring of a changing document collection on Spark."""
