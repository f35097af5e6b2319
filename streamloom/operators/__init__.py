"""DataFrame operators over the message log."""
