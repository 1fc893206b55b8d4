"""Reading raw day-files, extracting events, and keeping them."""
