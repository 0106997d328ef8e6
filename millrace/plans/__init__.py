"""Job specs and their compilation into one DataFrame plan."""
