"""Clean, de-identify, model, locate and analyse incident records with Spark."""
