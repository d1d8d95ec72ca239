"""lodestrata: portfolio research over return panels, written as Spark plans."""
