"""Evidence, matching and coverage analytics as plain DataFrame functions."""
