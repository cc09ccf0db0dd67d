"""Composable DataFrame-to-DataFrame operators; every one takes the names of the columns it works on."""
