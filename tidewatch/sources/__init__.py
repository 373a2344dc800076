"""Where events and reference tables come from and go to."""
