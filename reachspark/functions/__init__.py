"""Column expressions: map algebra, bed shear, naming, seasons, channel hydraulics."""
