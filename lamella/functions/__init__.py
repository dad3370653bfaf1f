"""Column functions shared by the survey jobs."""
