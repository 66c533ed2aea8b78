"""Point-in-time analytics as composable DataFrame functions."""
