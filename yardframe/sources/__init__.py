"""Reading and refreshing the plays, rosters and teams tables."""
