"""tabprobe: plant, profile, answer and grade statistical phenomena in Spark tables."""
