"""Reading, writing and normalising of panels."""
