"""What surrounds a run: settings, layouts of codes, trials, results and their records."""
