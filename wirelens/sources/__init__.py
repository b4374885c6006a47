"""Where captures come from and run records go."""
