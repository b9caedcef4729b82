"""Run settings, the three-stage plan and the offline reasoner."""
