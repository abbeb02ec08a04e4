"""Where ledgers come from and go to."""
