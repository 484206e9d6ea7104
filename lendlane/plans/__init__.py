"""Jobs made of several operators in a fixed order."""
