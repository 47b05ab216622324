"""DataFrame -> DataFrame operators: lazy, parameterised, no driver-side data."""
