"""Where the base tables and stored rollups come from and go to."""
