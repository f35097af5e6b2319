"""Where messages come from and go to."""
