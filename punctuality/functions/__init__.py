"""Column functions: clocks, calendar, casts, labels and numeric guards."""
