"""Plans that several operators use."""
