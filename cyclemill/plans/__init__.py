"""Plans of analyses as data: what may be called, in what order, and how results are written up."""
