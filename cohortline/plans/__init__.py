"""The study expressed with the operators: fixed values, linkage, derivation, models."""
