"""Where records come from and go to: streams, stored tables, zones."""
